import json

import pytest
from pyspark.sql import functions as F

from quaymark.models import mapping
from quaymark.models.language import ModelError, Resolved, merged, parse, scanned
from quaymark.models.machines import declared_events, machines

HARBOUR = """###Pure
// calls of ships at a quay
import quay::units::*;
Enum quay::Phase { EXPECTED, MOORED, SAILED }
Class quay::Call [ sane: $this.cargo->isEmpty() || true ]
{
  callSign: String[1]; phase: Phase[1] = Phase.EXPECTED; dues: Fee[0..1]; mooredAt: DateTime[0..1]; tideDay: StrictDate[0..1]; towed: Boolean[0..1]; smState: Integer[0..1]; pilots: String[*];
  pieces() { $this.cargo->size() } : Integer[1];
}
Class quay::CargoPiece { mark: String[1]; tally: Integer[1] = 1; worth: Fee[1]; }
Association quay::Manifest { call: Call[1]; cargo: CargoPiece[*]; }
"""
UNITS = "Enum quay::units::Coin { CROWN, THALER }\nClass quay::units::Fee { worth: Decimal[1]; coin: Coin[1] = Coin.CROWN; }"
NESTED = """Class g::Glacier { tongue: Tongue[0..1]; parentIce: Glacier[0..1]; }
Class g::Tongue { crevasse: Crevasse[0..1]; } Class g::Crevasse { bridge: Bridge[0..1]; } Class g::Bridge { span: Float[1]; }
Class g::Stake { height: Integer[1]; } Class g::Reading { frozen: Boolean[1]; }
Association g::GlacierStakes { glacier: Glacier[1]; stakes: Stake[*]; }
Association g::StakeReadings { stake: Stake[1]; readings: Reading[*]; }"""


def harbour():
    return Resolved(merged([parse(HARBOUR, "harbour"), parse(UNITS, "units"), parse(UNITS, "units once more")]))


@pytest.mark.parametrize("words", [("quay",), ("tide", "day"), ("mooring", "line", "count"), ("pier9", "gate")])
def test_snake_joins_words(words):
    camel = words[0] + "".join(w.capitalize() for w in words[1:])
    assert mapping.snake(camel) == "_".join(words)


def test_snake_of_capitals():
    assert mapping.snake("VHFChannel") == "vhf_channel" and mapping.snake("dieselVHF") == "diesel_vhf" and mapping.snake("plain") == "plain"


@pytest.mark.parametrize("ending, plural", [("y after a consonant: ferry", "ferries"), ("y after a vowel: quay", "quays"), ("s: truss", "trusses"), ("x: annex", "annexes"), ("ch: winch", "winches"), ("sh: marsh", "marshes"), ("z: quartz", "quartzes"), ("else: berth", "berths")])
def test_plural_by_ending(ending, plural):
    assert mapping.plural(ending.split()[-1]) == plural


def test_roots_of():
    assert mapping.roots_of("tug: quay::Tug,, crane:quay::yard::Crane") == {"tug": "quay::Tug", "crane": "quay::yard::Crane"}
    for bad in ("tug", ":quay::Tug", "quay::yard::Crane"):
        with pytest.raises(ModelError):
            mapping.roots_of(bad)


def test_env_list_is_the_base_then_suffixes_in_order():
    suffixes = ["M", "B", "X", "A"]
    env = {f"BERTHS_{s}": f" b{s.lower()} " for s in suffixes} | {"BERTHS_N": "", "BERTHSIDE": "another variable"}
    tail = [f"b{s.lower()}" for s in sorted(suffixes)]
    assert mapping.env_list(env, "BERTHS", "none").split(",") == ["none", *tail]
    assert mapping.env_list(env | {"BERTHS": "b0"}, "BERTHS", "none").split(",") == ["b0", *tail]
    assert mapping.env_list({}, "BERTHS", "none") == "none"


def test_root_table_and_its_list():
    s = mapping.schema(harbour(), {"call": "quay::Call"})
    assert [t.name for t in s.tables] == ["calls", "call_cargo"]
    root = s.root("call")
    own = {c.name: c.type for c in root.columns[len(mapping.ROOT_COLUMNS) :]}
    assert own == {"call_sign": "STRING", "phase": "ENUM", "dues_worth": "DECIMAL", "dues_coin": "ENUM", "moored_at": "TIMESTAMPTZ", "tide_day": "DATE", "towed": "BOOLEAN", "model_sm_state": "BIGINT", "pilots": "JSON"}
    assert (root.column("dues_coin").path, root.column("dues_coin").group) == (("dues", "coin"), "dues")
    assert [c.name for c in s.table("call_cargo").columns] == ["entity_id", "entity_version", "idx", "mark", "tally", "worth_worth", "worth_coin"]


def test_what_is_too_deep_stays_json():
    s = mapping.schema(Resolved(parse(NESTED)), {"ice": "g::Glacier"})
    assert {c.name: c.type for c in s.root("ice").columns if c.type == "JSON" and c.name not in dict(mapping.ROOT_COLUMNS)} == {"tongue_crevasse_bridge": "JSON", "parent_ice": "JSON"}
    assert s.table("ice_stakes").column("readings").type == "JSON"


def test_a_root_of_its_own_is_no_child():
    s = mapping.schema(Resolved(parse(NESTED)), {"ice": "g::Glacier", "stake": "g::Stake"})
    assert sorted(t.name for t in s.tables) == ["ices", "stake_readings", "stakes"]


def test_event_roots_lead_with_lifecycle():
    r = mapping.schema(harbour(), {"evt_call_announced": "quay::Call"}).root("evt_call_announced")
    names = [c.name for c in r.columns]
    assert names[: len(mapping.ROOT_COLUMNS)] == [n for n, _ in mapping.ROOT_COLUMNS] and {n for n, _, _ in mapping.EVENT_COLUMNS} < set(names) and names.index("call_sign") == len(mapping.ROOT_COLUMNS) + len(mapping.EVENT_COLUMNS)
    assert r.column("call_sign").path == ("payload", "callSign")


@pytest.mark.parametrize("text", [
    "Class a::A { x: Nope[1]; }", "Class a::A { x: String[2..1]; }", "Class a::A { x: String[1]; x: String[1]; }", "Enum a::E { A, A }", "Class a::A extends B { } Class a::B extends A { }",
    "Class a::A { x: Integer[1] = 'no'; }", "Enum a::E { A } Class a::A { x: E[1] = E.B; }", "Class a::A { x: String[1] ", "Thing a::A { }", "Association a::X { one: A[1]; } Class a::A { }", "Class a::A { } Class a::A { }",
])
def test_errors_name_the_place(text):
    with pytest.raises(ModelError, match=r"file:\d+:\d+"):
        Resolved(parse(text, "file"))


def test_conflicting_files():
    with pytest.raises(ModelError):
        merged([parse("Enum a::E { A }"), parse("Enum a::E { B }")])


def test_scanned_folders(tmp_path):
    for name, text in (("a/harbour.pure", HARBOUR), ("b/deep/units.pure", UNITS), ("b/again.pure", UNITS), ("b/notes.txt", "no model")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    model = scanned([str(tmp_path / "a"), f"file://{tmp_path}/b"])
    assert set(model.classes) == set(harbour().model.classes)
    (tmp_path / "b/bad.pure").write_text("Class a::A {")
    with pytest.raises(ModelError, match="bad.pure:"):
        scanned([str(tmp_path / "b")])
    with pytest.raises(ModelError, match="no .pure file"):
        scanned([str(tmp_path / "none")])


MACHINE = """Class <<x::sm.root>> { x::sm.type = 'claim', x::sm.initial = 'NEW', x::sm.transitions = 'NEW -file-> OPEN : File; OPEN -pay-> PAID; OPEN -drop-> GONE',
  x::sm.locks = 'file, pay: policy:{policyId}, other:{id}', x::sm.statusProperty = 'status', x::sm.idProperty = 'id' } m::Claim { id: String[1]; status: String[1]; }
Class m::File { policyId: String[1]; }"""


def test_machines():
    m = machines(Resolved(parse(MACHINE)))["claim"]
    assert m.terminals == {"PAID", "GONE"} and m.target("OPEN", "pay") == "PAID" and m.target("NEW", "pay") is None
    assert m.locks["pay"] == ["policy:{policyId}", "other:{id}"] and m.states() == ["NEW", "OPEN", "PAID", "GONE"]
    for old, new in (("OPEN -pay-> PAID", "LOST -pay-> PAID"), ("OPEN -drop->", "OPEN -pay->"), ("'status', x", "'nope', x"), (": File", ": Nope"), ("file, pay:", "file, nope:"), ("NEW -file-> OPEN", "NEW file OPEN")):
        with pytest.raises(ModelError):
            machines(Resolved(parse(MACHINE.replace(old, new))))


def snapshot(model, **over):
    doc = {"entityId": "h1", "smType": "call", "state": "MOORED", "version": 3, "createdAt": "2031-05-06T00:00:00Z"} | over | {"model": model}
    return json.dumps({k: v for k, v in doc.items() if v is not ...})


def test_snapshot_rows(spark):
    s = mapping.schema(harbour(), {"call": "quay::Call"})
    texts = [
        snapshot({"callSign": "7", "dues": {"worth": "12.34567"}, "towed": "x", "cargo": [{"mark": "A", "tally": 2, "worth": {"worth": 1}}, {"mark": "B"}], "pilots": [1]}),
        snapshot({"dues": {"worth": 1e40}, "towed": True, "cargo": []}, entityId="h2"), snapshot(None, entityId="h3", version=...),
        None, "nope", "[1]", '{"smType":"call"}', '{"entityId":"x"}', snapshot({}, createdAt="soon"), snapshot({}, smType="tide"),
    ]
    good, bad = mapping.decoded(spark.createDataFrame([(t,) for t in texts], "value string"), F.col("value"))
    assert sorted(r.error for r in bad.collect()) == ["no entityId", "no smType", "not JSON", "not an object", "unreadable createdAt"]
    rows = {r.entity_id: r for r in mapping.table_rows(good, s, "calls").collect()}
    assert set(rows) == {"h1", "h2", "h3"} and str(rows["h1"].dues_worth) == "12.3457" and rows["h2"].dues_worth is None and rows["h3"].entity_version == 0 and rows["h1"].pilots == "[1]"
    assert rows["h1"].towed is None and rows["h2"].towed is True
    pieces = sorted((r.entity_id, r.idx, r.mark, r.tally) for r in mapping.table_rows(good, s, "call_cargo").collect())
    assert pieces == [("h1", 0, "A", 2), ("h1", 1, "B", None)]


EVENTS = """Class <<x::event.state>> { x::event.key = 'order:{orderId}' } o::Order { orderId: String[1]; }
Class <<x::event.event>> { x::event.domain = 'orders', x::event.locks = 'order:{orderId}, customer:{customerId}', x::event.emits = 'Done', x::event.retries = '3', x::event.onError = 'block' } o::Create { orderId: String[1]; customerId: String[1]; }
Class <<x::event.event>> { x::event.domain = 'orders' } o::Done { orderId: String[1]; }"""


def test_declared_events():
    events, states = declared_events(Resolved(parse(EVENTS)))
    assert states["o::Order"].key == "order:{orderId}" and events["Create"].locks == ("order:{orderId}", "customer:{customerId}") and events["Create"].retries == 3 and events["Create"].on_error == "block" and events["Done"].locks == ()
    for old, new in (("'Done'", "'Nope'"), ("'3'", "'21'"), ("'block'", "'shout'"), ("customer:{customerId}", "customer:{nope}"), (".domain = 'orders' }", ".name = 'x' }"), ("'order:{orderId}' }", "'' }")):
        with pytest.raises(ModelError):
            declared_events(Resolved(parse(EVENTS.replace(old, new))))
    assert mapping.event_type_name("TideTurnEvent") == "evt_tide_turn_event"
