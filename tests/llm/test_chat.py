import duckdb

from graphloom.llm import chat
from graphloom.llm.queries import HOSTILE, OP6_SQL, op6_chat_formatting
from tests.llm.helpers import SF, sha


def test_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = op6_chat_formatting(spark, SF)
    want = db.execute(OP6_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_hostile_and_odd_turns(spark):
    rows = [(1, 0, "user", HOSTILE), (1, 1, "assistant", HOSTILE + "&lt;| &amp; <"), (1, 2, "assistant", None), (1, 3, "user", "\n"), (2, 5, "as&\nsist<|x|>", "a"), (2, 5, "as&\nsist<|x|>", "a"), (3, None, None, None), (3, 1, "a&nl;b\n&amp;nl;", "c&nl;"), (None, 1, "assistant", "\U0001f600<")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS t", "2 AS example")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in (1, 2, 3, None):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), sha(loss))
    assert chat.read_back(chat.format_conversations(df.where("turn > 99"))).count() == 0


def test_examples_have_only_the_turns_before(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "r"), (1, 3, "assistant", "a2"), (1, 4, "user", "z")], "conv_id long, turn long, role string, text string")
    rows = chat.format_conversations(df).orderBy("example").collect()
    assert [(r.formatted.count("<|im_start|>"), r.formatted[r.loss_start - 1 : r.loss_start - 1 + r.loss_chars], r.last) for r in rows] == [(2, "a1", False), (4, "a2", False), (5, "", True)]
