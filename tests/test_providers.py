import pytest

from quaymark.models.language import Resolved, parse
from quaymark.models.machines import payload_errors
from quaymark.providers import provider, register


class Fixed:
    def machines(self):
        return {}


def test_registry():
    register("machines", "fixed", Fixed)
    register("machines", "wrong", dict)
    assert provider("machines", "fixed").machines() == {}
    with pytest.raises(ValueError, match="already"):
        register("machines", "fixed", Fixed)
    with pytest.raises(ValueError, match="kind"):
        register("boats", "x", Fixed)
    with pytest.raises(KeyError, match="known: fixed, wrong"):
        provider("machines", "none")
    with pytest.raises(TypeError):
        provider("machines", "wrong")


MODEL = """Enum k::Wind { N, S } Class k::Mast { height: Decimal[1]; }
Class k::Sail { name: String[1]; area: Integer[0..1]; wind: Wind[1] = Wind.N; masts: Mast[1..2]; tags: String[*]; raised: DateTime[0..1]; torn: Boolean[0..1]; }"""


def test_payloads_against_their_class():
    r = Resolved(parse(MODEL))
    errors = lambda p: payload_errors(r, "k::Sail", p)
    assert errors({"name": "jib", "masts": [{"height": "4.5"}], "extra": 1}) == []
    assert errors({"name": "jib", "area": 3, "wind": "S", "masts": [{"height": 1}, {"height": 2.5}], "tags": ["a"], "raised": "2031-01-02T03:04:05Z", "torn": False}) == []
    assert errors([]) == ["payload: no object"]
    assert errors({"area": True, "wind": "E", "masts": [{"height": "tall"}, {}, 3], "tags": "a", "raised": "soon", "torn": "no"}) == [
        "name: missing", "area: no Integer", "wind: no k::Wind", "masts: more than 2", "masts[0].height: no Decimal", "masts[1].height: missing", "masts[2]: no object", "tags: no list", "raised: no DateTime", "torn: no Boolean",
    ]
    assert errors({"name": None, "masts": []}) == ["name: missing", "masts: missing"]
