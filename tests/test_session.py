import os
import subprocess
import sys

from quaymark.session import Files

RUN = """
from quaymark.session import build_session, materialize, scratch
spark = build_session("scratch", cores=1, **{"spark.checkpoint.dir": "DIR"})
d = materialize(spark.range(5), "kept")
again = materialize(d.where("id > 2"), "kept")
open(scratch(spark, "other").removeprefix("file:") + "/x", "w").close()
import os
print("rows", d.count(), again.count(), sum(n.startswith(("kept", "other")) for n in os.listdir("DIR")), flush=True)
"""


def test_scratch_goes_with_the_driver(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shared = tmp_path / "shared"
    shared.mkdir()
    (shared / "of-another").mkdir()
    done = subprocess.run([sys.executable, "-c", RUN.replace("DIR", str(shared))], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert "rows 5 2 3" in done.stdout, done.stderr[-2000:]
    assert not [n for n in os.listdir(shared) if n.startswith(("kept", "other"))] and "of-another" in os.listdir(shared)


def test_files(spark, tmp_path):
    f = Files(spark, str(tmp_path))
    assert f.names(f"{tmp_path}/none") == []
    assert f.write_new(f"{tmp_path}/a.json", "ä1") and not f.write_new(f"{tmp_path}/a.json", "2") and f.read(f"{tmp_path}/a.json") == "ä1"
    assert [n for n in f.names(str(tmp_path)) if not n.startswith(".")] == ["a.json"]
    f.delete(f"{tmp_path}/a.json")
    assert f.names(str(tmp_path)) == []
