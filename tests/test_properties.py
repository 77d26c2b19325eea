"""Properties that hold for any input: round trips, idempotence, and parsers that never fail."""

import csv
import io
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from inkflow.sinks.package import Writer, problems
from inkflow.sources.delimited import compact, csv_rows, number_text
from inkflow.sources.ir import clean
from inkflow.sources.registry import FORMATS, parse_one

CELL = st.text(alphabet=st.sampled_from('ab,"\n\t é漢'), max_size=6)
MARKUP = st.text(alphabet=st.sampled_from("# *_`~[]()!<>/=&;:-+.1|\n\tabp\"'\\x"), max_size=80)
VALUE = st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(CELL, min_size=1, max_size=4), max_size=5))
def test_csv_round_trip(rows):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
    assert csv_rows(out.getvalue(), ",") == [r for r in rows if any(c.strip() for c in r)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_clean_is_idempotent(s):
    assert clean(clean(s)) == clean(s)


@settings(max_examples=300, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_read_back(x):
    assert float(number_text(x)) == x


@settings(max_examples=200, deadline=None)
@given(VALUE)
def test_json_is_always_parsed(v):
    d = parse_one("json", json.dumps(v))
    assert d["status"] == "done"
    json.loads(compact(v))


@settings(max_examples=400, deadline=None)
@given(MARKUP, st.sampled_from(["md", "html", "txt"]))
def test_markup_never_fails_and_packages_pass(text, ext):
    d = parse_one(ext, text)
    assert d["status"] == "done", d["error"]
    assert problems(Writer(d).build()) == []
    ids = [b["block_id"] for b in d["blocks"]]
    assert len(ids) == len(set(ids)) and all(b["parent_id"] in ids or b["parent_id"] is None for b in d["blocks"])


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.sampled_from(FORMATS))
def test_any_bytes_give_a_row(data, ext):
    assert parse_one(ext, data)["status"] in ("done", "error", "unsupported")
