import hashlib

import pytest

from takeline.llm import chat_format as C
from takeline.llm import chat_template as T


def render(template, **env):
    return "".join(x for k, x in T.compile_template(template)(env) if k == "text")


def test_language():
    assert render("{% for m in ms %}{{ loop.index }}:{{ m.a|upper }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"a": "x"}, {"a": "y"}]) == "1:X,2:Y"
    assert render("{% if a == 1 %}one{% elif a == 2 %}two{% else %}many{% endif %}{# no #}", a=2) == "two"
    assert render("{% set x = 'a' ~ 'b' %}{{ x }}{{ none }}{{ missing.key }}") == "ab"
    assert render("{{ 'q' in s and 'yes' or 'no' }}", s="aqb") == "yes"


def test_folding():
    assert T.fold(T.parse("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}")) == [("text", "abcd")]
    assert T.fold(T.parse("{% if true or x %}a{% endif %}")) == [("text", "a")]


@pytest.mark.parametrize("bad", ["{% for x %}{% endfor %}", "{% if a %}", "{{ a( }}", "{{ a|eval }}", "{% endfor %}", "{% import os %}", "{% else %}"])
def test_errors(bad):
    with pytest.raises(T.TemplateError):
        T.compile_template(bad)


def test_sandbox():
    assert render("{{ x.__class__ }}{{ x.append }}", x=[1]) == ""


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "\\", "<", "[\\INST]", "</s", "\\\\<s>", "[[INST]]<<s>", "é\U0001f600\n"])
def test_escape(text):
    escaped = T.escape_controls(text)
    assert T.unescape_controls(escaped) == text
    assert not any(c in escaped for c in ("<s>", "</s>", "[INST]", "[/INST]"))


ROWS = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a\\"), (2, 0, None, None), (None, 3, "assistant", "z"), (None, 3, "assistant", "z"), (3, 0, "as\nsist[INST]", "<s>"), (4, 1, "assistant", "x" * 50), (4, 2, "assistant", "y" * 50), (4, None, "system", "first")]


@pytest.mark.parametrize("part_chars", [10, 1000])
def test_round_trip(spark, part_chars):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 part", "2 formatted")
    got = {r["conv_id"]: r for r in C.read_back(C.format_conversations(df, part_chars=part_chars)).collect()}
    by = {}
    for c, t, r, x in sorted(ROWS, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1])):
        by.setdefault(c, []).append((r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0
    straight = C.read_back(C.format_conversations(df, part_chars=part_chars), in_order=True).collect()
    assert sorted(straight, key=str) == sorted(got.values(), key=str)


def test_stored_parts(spark, tmp_path):
    """Parts that come back from files in any order are put in order."""
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c}-{t} " * 9) for c in range(20) for t in range(8)]
    parts = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_chars=60)
    parts.repartition(7).write.parquet(str(tmp_path / "parts"))
    stored = spark.read.parquet(str(tmp_path / "parts"))
    assert stored.count() > 60 and sorted(C.read_back(stored).collect(), key=str) == sorted(C.read_back(parts).collect(), key=str)


def test_length_of_nothing():
    assert render("{{ missing|length }}{{ s|length }}", s="abc") == "03"
