import duckdb
import pandas as pd

from fieldspark.llm import decontamination as op

ITEMS = [
    (0, "A train leaves Boston at 9:30 and travels 120 km to reach Denver in 3 hours how fast is it"),
    (1, "Every good boy deserves fudge on each sunny afternoon in the park"),
    (2, "only five short words here"), (3, "too short"), (4, None), (5, ""),
    (6, "Today Anna has 5 apples and gives 5 apples to Peter so Anna keeps 0 apples for later today"),
]
DOCS = [
    (1, "Intro. A train leaves Boston at 9:30 and travels 120 km to reach Denver in 3 hours how fast is it? End."),
    (2, "Well, a train leaves Paris at 7:15 and travels 80 km to reach Rome in 2 hours how fast is it"),
    (3, "nothing of note in this text at all, just words"),
    (4, None), (5, ""), (6, "  \n"),
    (7, "say: EVERY good boy deserves fudge, on each sunny afternoon in the park."),
    (8, "we saw only five short words here and went on"),
    (9, "every good boy deserves fudge on each monday"),
    (10, "today Anna has 7 apples and gives 9 apples to Peter so Mary keeps 1 apples for later today"),
    (11, "today Lisa has 7 apples and gives 7 apples to Karl so Lisa keeps 1 apples for later today"),
    (7, "say: EVERY good boy deserves fudge, on each sunny afternoon in the park."), (None, "every good boy deserves fudge on each sunny afternoon in the park"),
]


def test_cases_and_oracle(spark):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, item_id int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for most in (1_000_000, 0):
        got = sorted(map(tuple, op.leaks(docs, items, most_broadcast=most).collect()), key=str)
        assert {r[:2] for r in got} == {(1, 0), (2, 0), (7, 1), (8, 2), (11, 6), (None, 1)}
    c = duckdb.connect()
    c.register("documents", pd.DataFrame([d for d in DOCS if d[0]], columns=["doc_id", "text"]))
    c.register("benchmark", pd.DataFrame(ITEMS, columns=["item_id", "text"]))
    want = sorted(c.sql(op.ORACLE_SQL).fetchall(), key=str)
    assert [tuple(r) for r in want] == [r for r in got if r[0]]


def test_empty(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert op.leaks(docs.where("false"), items).collect() == [] and op.leaks(docs, items.where("false")).collect() == []


def found(spark, texts, items=ITEMS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return {r[:2]: tuple(r[2:]) for r in map(tuple, op.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())}


def test_several_occurrences_in_one_document(spark):
    copy = ITEMS[0][1]
    one = "a train leaves Paris at 7:15 and travels 80 km to reach Rome in 2 hours how fast is it"
    two = "a train leaves Oslo at 6:40 and travels 95 km to reach Bergen in 4 hours how fast is it"
    longer = two.replace("and travels", "and then travels")
    mixed = "we saw a train leaves Oslo at 6:40 and travels 95 km to reach home, later Rome at 7:15 and travels 80 km to reach Turin in 2 days"
    texts = [f"Intro. {copy}. Also: {one}", f"List: {one}. {two}", f"List: {one}. {longer}. {two}", " ".join([one, two] * 40), mixed]
    got = found(spark, texts)
    assert set(got) == {(k, 0) for k in range(4)}
    assert all(r[2] == 1.0 and r[4] == 1.0 for r in got.values())
    # an occurrence with a word more than the item has is one, also beside others
    short = "a train leaves Rome at 8:20 and travels 70 km"
    assert (0, 0) in found(spark, [f"List: {short}. {short.replace('Rome', 'Bari')}. {longer}"])


def test_copies_behind_any_word(spark):
    items = [(0, "What is the capital of France?"), (1, "Days pass while only patience can help"), (2, "boston is where we all met"), (3, "Hours later they came with 5 km behind")]
    texts = [
        "Question 12\nWhat is the capital of France?", "Heading, What is the capital of France?", 'He said: "yes." What is the capital of France?', "End. What is the capital of France?",
        "Question 12\nDays pass while only patience can help", "Label\nDays pass while only patience can help", "so it was hours later they came with 7 km behind",
        "We know Paris is the capital of France", "We know 12 hours pass while only patience can help",
    ]
    got = found(spark, texts, items)
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 3)}
    assert all(r[:3] == (1, 1, 1.0) for r in got.values())


def test_long_verbatim_runs(spark):
    words = [f"w{k}x" for k in range(59)]
    named = "We met Anna in Rome before Karl left for Oslo with 12 friends and nobody else came along that cold winter evening although we had asked them all so kindly"
    items = [(0, " ".join(words)), (1, named)]
    part = " ".join(named.split()[2:15])
    texts = [
        "see " + " ".join(words[20:45]) + " there", "see " + " ".join(words[20:33]) + " there", "see " + " ".join(words[20:32]) + " there", "see " + " ".join(words[:12]) + " and " + " ".join(words[12:24]),
        f"so {part} too", "so " + part.replace("Rome", "Bari") + " too", "so " + " ".join(named.split()[2:14]) + " too",
    ]
    got = found(spark, texts, items)
    assert set(got) == {(0, 0), (1, 0), (4, 1)}
    assert got[0, 0] == (52, 18, 18 / 52, 0, 1.0) and got[1, 0] == (52, 6, 6 / 52, 0, 1.0)
