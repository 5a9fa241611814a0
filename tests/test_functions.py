import re
from datetime import UTC, datetime, timedelta, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.errors import QueryValidationError, TimestampParseError, ValidationError
from tidemark.functions.paths import escape_segment, join_path, split_path
from tidemark.functions.patterns import java_regexp, like_pattern
from tidemark.functions.validation import clone_payload, encoded_bytes, epoch_ms, js_number, stable_json


@given(st.lists(st.text(alphabet="a.\\'\" b", max_size=6), min_size=1, max_size=4))
def test_paths_round_trip(segments):
    assert split_path(join_path(segments)) == segments


def test_paths():
    assert split_path("user.profile.country") == ["user", "profile", "country"]
    assert split_path(r"service\.name.x\\y") == ["service.name", r"x\y"]
    assert split_path("a\\") == ["a\\"] and split_path(r"a\b") == [r"a\b"]
    assert escape_segment("a.b") == r"a\.b"


@pytest.mark.parametrize("pattern", ["(a+)+", "(?:a|b*)+", "((a{2})b)*", "a(?=b)", "a(?!b)", "(?<=a)b", "(?<!a)b", r"(a)\1", r"\k<n>", "[", "(", ")", "a**", "{", "}", "]", "*a", "a{2,1}", r"\q", r"\A", "[b-a]", r"[\d-x]", "x" * 257, "\\", r"\u{110000}", "a++"])
def test_refused_patterns(pattern):
    with pytest.raises(QueryValidationError):
        java_regexp(pattern)


@pytest.mark.parametrize("pattern", ["^sensor-[0-9]+$", "a|b", "(ab)+", "(a+)(b+)", r"[\w.-]+@x", "x{2,3}?", "", "[^]", r"\u{1F600}", r"\cJ", "(?<name>a)b", "[a-z&&b]", "é"])
def test_allowed_patterns(pattern):
    assert isinstance(java_regexp(pattern), str)


def test_like_pattern():
    assert like_pattern("a\\b%") == "a\\\\b%"
    like_pattern("😀" * 128)
    for bad in ("x" * 257, "😀" * 129):
        with pytest.raises(QueryValidationError):
            like_pattern(bad)


def test_timestamps():
    assert epoch_ms("2025-01-01T00:00:00Z") == 1735689600000
    assert epoch_ms("2025-01-01T09:00:00.5+09:00") == 1735689600500
    assert epoch_ms("1969-12-31T23:59:59.999Z") == -1
    assert epoch_ms(datetime(2025, 1, 1, tzinfo=UTC)) == epoch_ms(datetime(2025, 1, 1, 9, tzinfo=timezone(timedelta(hours=9)))) == 1735689600000
    assert epoch_ms(5.0) == 5 and epoch_ms(-(2**53) + 1) == -(2**53) + 1
    for bad in ("2025-01-01T00:00:00", "2025-01-01", "not a date", "2025-02-30T00:00:00Z", "2025-01-01T00:00Z", datetime(2025, 1, 1)):
        with pytest.raises(TimestampParseError):
            epoch_ms(bad)
    for bad in (2**53, 1.5, True, None, [], float("nan")):
        with pytest.raises(ValidationError):
            epoch_ms(bad)


def nested(depth):
    out = {"leaf": "ok"}
    for i in reversed(range(depth)):
        out = {f"k{i}": out}
    return out


def test_payload_rules():
    assert clone_payload({"a": {"b": None}, "c": [1][0]}) == {"a": {"b": None}, "c": 1}
    clone_payload(nested(64))
    loop = {}
    loop["self"] = loop
    wide = {f"k{i}": {f"n{j}": 1 for j in range(16)} for i in range(256)}
    for bad in ([], None, {"a": []}, {"a": 2**53}, {"a": float("inf")}, {"": 1}, {"k" * 1025: 1}, {"a": "x" * 65_536}, loop, nested(65), {1: 2}, {"a": (1,)}, {f"k{i}": 1 for i in range(257)}, wide, {f"k{i}": "x" * 5000 for i in range(256)}, {"a": datetime.now()}):
        with pytest.raises(ValidationError):
            clone_payload(bad)
    same = {"x": 1}
    assert clone_payload({"a": same, "b": same}) == {"a": {"x": 1}, "b": {"x": 1}}


def test_sizes():
    assert [js_number(x) for x in (1, 1.0, -0.0, 0.1, 1e21, 1e20, 1e-6, 1e-7, 1.5e-9, 5e-324, 123456.789)] == ["1", "1", "0", "0.1", "1e+21", "100000000000000000000", "0.000001", "1e-7", "1.5e-9", "5e-324", "123456.789"]
    assert stable_json({"b": 1, "a": {"é": True, "B": None}}) == '{"a":{"B":null,"é":true},"b":1}'
    assert encoded_bytes(12, {"é": "x"}) == len('12|{"é":"x"}'.encode())


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_read_back(x):
    assert float(js_number(x)) == x
    assert re.fullmatch(r"-?\d+(\.\d+)?(e[+-]\d+)?", js_number(x))
