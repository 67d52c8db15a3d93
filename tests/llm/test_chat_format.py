import hashlib

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm import chat_format as C
from tidemark.llm import registry

SCHEMA = "conv_id long, turn long, role string, text string, segments string, level int"
PARTS = st.lists(st.sampled_from([*C.CONTROLS, C.ESCAPE, "0", "1", "9", " ", "a", "é🙂", "\n", "<", "[", "/INST]", "</s", ">", "[INST"]), max_size=8).map("".join)


def check(spark, rows):
    found = {r.conv_id: r for r in C.digest(C.format_conversations(spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA))).collect()}
    raw = {r.conv_id: r for r in C.format_conversations(spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(found) == set(by)
    for c, turns in by.items():
        turns.sort()
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        r = found[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len(raw[c].formatted) and "".join(s.text for s in raw[c].segments) == raw[c].formatted


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 3), st.sampled_from(["user", "assistant", "system", "tool", "[:]", "", None]), PARTS), min_size=1, max_size=120))
def test_every_conversation_comes_back(spark, rows):
    check(spark, rows)


def test_cases(spark):
    long = "word " * 200_000
    check(spark, [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (None, 0, "user", "hi"), (2, None, None, "x"), (3, 0, "user", long + "[/INST]"), (3, 1, "assistant", long + " </s>")])
    assert C.digest(C.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_only_conflicting_texts_are_escaped(spark):
    rows = [(1, 0, "user", "plain <s>"), (1, 1, "assistant", "bad </s> text"), (2, 0, "user", "plain")]
    found = {r.conv_id: r for r in C.format_conversations(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect()}
    assert found[1].level == 1 and "plain <s> [/INST]" in found[1].formatted and f"bad {C.ESCAPE}4 text" in found[1].formatted and found[2].level == 0


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    expected = con.execute(C.ORACLE).fetchdf().sort_values("conv_id").reset_index(drop=True)
    found = registry.op4_chat_format(spark, sf).toPandas().sort_values("conv_id").reset_index(drop=True)[list(expected.columns)]
    assert (found.astype(str) == expected.astype(str)).all().all()
