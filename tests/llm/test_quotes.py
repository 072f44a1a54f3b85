import pytest

from peptaflow.llm.quotes import link_quotes


def messages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, thread string, c int").repartition(3)


def find(df):
    return {(r["conv_id"], r["turn"]): r.asDict() for r in df.collect()}


ROWS = [
    (1, 0, "user", "Where is the red ball?\nI lost it yesterday evening."),
    (1, 1, "assistant", "Look under the old table."),
    (1, 2, "user", "On Monday, A wrote:\n> Where is the  RED ball?\n> I lost it yesterday evening.\nI have seen it near the garden door."),
    (1, 3, "assistant", "> I have seen it near the garden door.\n> > Where is the red ball?\n> > I lost it yesterday evening.\nThank you, found it at last."),
    (1, 4, "user", ">> Where is the red ball?\n>> I lost it yesterday evening.\nSame question here."),
    (1, 5, "user", "> nobody ever wrote this line\nHm."),
    (2, 0, "user", "> Look under the old table.\nQuoted from elsewhere."),
    (2, 1, "user", None), (2, 2, "user", ""), (2, 2, "user", ""), (None, 3, "user", "> Look under the old table."), (3, None, None, "text"),
]
SHORT = [
    (1, 0, "user", "Shall I send it by mail?\nYes please\nor not at all, as you like."), (1, 1, "assistant", "> Yes please\nDone."),
    (1, 2, "user", "One more thing\nto do\nnow\nand then we rest."), (1, 3, "assistant", "> to do\n> now\nAgreed."),
    (2, 0, "user", "> Yes please\nTaken from elsewhere."),
]


def test_links(spark):
    df = link_quotes(messages(spark, ROWS))
    assert df.count() == len(ROWS)
    got = find(df)
    assert got[1, 2]["parent_turn"] == 0 and got[1, 2]["text"] == "I have seen it near the garden door."
    assert got[1, 3]["parent_turn"] == 2 and got[1, 3]["thread_turn"] == 0 and got[1, 3]["depth"] == 2 and got[1, 3]["n_quotes"] == 2
    assert got[1, 3]["text"] == "Thank you, found it at last."
    assert got[1, 4]["parent_turn"] == 0 and got[1, 1]["thread_turn"] == 1
    assert got[1, 5]["parent_turn"] is None and got[1, 5]["n_quotes"] == 1
    assert (got[2, 0]["source_conv"], got[2, 0]["source_turn"], got[2, 0]["parent_turn"]) == (1, 1, None)
    order = [r["turn"] for r in df.collect() if r["conv_id"] == 1]
    assert order == [0, 2, 3, 4, 1, 5]


def test_long_chain(spark):
    rows = [(7, 0, "user", "message number zero")] + [(7, i, "user", f"> message number {'zero' if i == 1 else i - 1}\nmessage number {i}") for i in range(1, 40)]
    got = find(link_quotes(messages(spark, rows)))
    assert [got[7, i]["depth"] for i in range(40)] == list(range(40)) and {r["thread_turn"] for r in got.values()} == {0}


def test_no_quotes_and_empty(spark):
    plain = link_quotes(messages(spark, [(1, 0, "user", "a\n"), (1, 1, "user", None)]))
    assert [(r["turn"], r["text"], r["thread_turn"]) for r in plain.collect()] == [(0, "a", 0), (1, "", 1)]
    assert link_quotes(messages(spark, [(1, 0, "u", "x")]).limit(0)).collect() == []


def test_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    from peptaflow.llm.quotes import ORACLE

    rows = [r for r in ROWS if r[0] is not None and r[1] is not None] + [(r[0] + 10, *r[1:]) for r in SHORT]
    pdf = messages(spark, rows).select("conv_id", "turn", "role", "text").toPandas()
    con = duckdb.connect()
    con.register("conversations", pdf)
    want = sorted((tuple(r) for r in con.execute(f"SELECT conv_id, turn, role, text, thread_turn, parent_turn, depth, n_quotes, source_conv, source_turn FROM ({ORACLE})").fetchall()), key=str)
    assert sorted((tuple(r) for r in link_quotes(messages(spark, rows)).collect()), key=str) == want


def test_short_lines_link_within_a_conversation(spark):
    got = find(link_quotes(messages(spark, SHORT)))
    assert (got[1, 1]["parent_turn"], got[1, 1]["thread_turn"], got[1, 1]["depth"]) == (0, 0, 1)
    assert got[1, 3]["parent_turn"] == 2 and got[1, 1]["source_conv"] is None
    assert got[2, 0]["parent_turn"] is None and got[2, 0]["source_conv"] is None


def test_ids_and_turns_of_text(spark):
    rows = [("c-x", "0", "user", "What is the time by your watch?"), ("c-x", "1", "user", "> What is the time by your watch?\nNoon."), ("c-x", "soon", "user", "> What is the time by your watch?\nLate."), ("d", "0", "user", "> What is the time by your watch?\nElsewhere.")]
    df = spark.createDataFrame(rows, "conv_id string, turn string, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in link_quotes(df).collect()}
    assert set(got) == {("c-x", 0), ("c-x", 1), ("c-x", None), ("d", 0)}
    assert got["c-x", 1]["parent_turn"] == 0 and got["d", 0]["source_conv"] == "c-x" and got["c-x", None]["parent_turn"] is None
    plain = spark.createDataFrame([("a", "1", "u", "x")], "conv_id string, turn string, role string, text string")
    assert link_quotes(plain).schema == link_quotes(df).schema
