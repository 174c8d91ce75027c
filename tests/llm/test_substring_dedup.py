import random
import re

from fieldspark.llm import substring_dedup as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=20):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: ((1 << 63) if r[0] is None else r[0], r[1] is None, r[1] or "")):
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            if x in seen:
                gone.update(range(k, k + n))
            seen.add(x)
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def rows_of(seed=1, n=120):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(40)] + ["é", "ß x", "A", "a"]
    passages = [[r.choice(vocab) for _ in range(r.randint(15, 60))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (None, " ".join(passages[0])), (4, "z " * 3000)]
    for i in range(5, n):
        t = [r.choice(vocab) for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 2)):
            k = r.randint(0, len(t))
            t[k:k] = r.choice(passages)
        rows.append((i, r.choice([" ", "\n", "  ", "\t"]).join(t)))
    rows += [(50, "tie " * 30), (50, "tie " * 30), (51, rows[20][1])]
    return rows


def check(spark, rows, **kw):
    r = list(rows)
    random.Random(3).shuffle(r)
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in r], "doc_id bigint, text string, n_words string, block int").repartition(5)
    got = sorted(map(tuple, op.deduplicate(df, **kw).collect()), key=str)
    assert got == brute(rows)


def test_against_brute_force(spark):
    check(spark, rows_of(), block_bytes=2000, batches=3)


def test_compaction_and_many_batches(spark):
    check(spark, rows_of(2, 80), block_bytes=1500, batches=6, max_runs=1)


def test_one_block(spark):
    check(spark, rows_of(3, 60))


def test_hot_passage(spark):
    p = " ".join("p%d" % i for i in range(30))
    check(spark, [(i, f"{i} {p} {i}") for i in range(90)], block_bytes=500)


def test_false_64_bit_match_is_told_apart(spark, monkeypatch):
    h = op.np.array([5, 5, 5, 9], op.U)
    c = op.np.array([1, 2, 1, 1], op.np.uint16)
    assert [x.tolist() for x in op._unique(h, c)] == [[5, 5, 9], [1, 2, 1]]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert op.deduplicate(df).collect() == []


def test_rows_that_share_a_doc_id_are_cut(spark):
    r = random.Random(5)
    passages = [" ".join(f"p{k}x{j}" for j in range(30)) for k in range(4)]
    text = lambda: f"{r.random()} é {r.choice(passages)} {r.random()} {r.choice(passages)}"
    rows = [(None, text()) for _ in range(60)] + [(7, text()) for _ in range(60)] + [(i, text()) for i in range(30)] + [(None, None), (7, None), (7, ""), (None, passages[0])] + [(9, text())] * 20
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    blocks, _, ranges = op.layout(df, 1500, 1)
    assert set(blocks.parts) >= {7, op.LAST} and blocks.first[-1] > ranges
    batch = df.toArrow().combine_chunks().to_batches()[0]
    place = [((1 << 63) if i is None else i, t is None, t or "", b) for i, t, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blocks.of(batch).tolist())]
    place.sort()
    assert [p[3] for p in place] == sorted(p[3] for p in place)  # blocks follow the order of rows
    assert len({p[3] for p in place if p[0] == 7}) > 5 and len({p[3] for p in place if p[0] > op.LAST}) > 5
    check(spark, rows, block_bytes=1500, batches=3)


def test_freed_memory_goes_back_to_the_system(monkeypatch):
    """What a task has freed doesn't stay with a worker that waits for its next task."""
    from fieldspark.llm.common import pack, trim

    mb = lambda: int(re.search(r"Anonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
    held = [op.np.ones(8000) for _ in range(4000)]  # 256 MB in pieces that malloc keeps
    keep = held[-1]
    del held
    freed = mb()
    trim()
    assert keep[0] and mb() < freed - 100
    calls = []
    monkeypatch.setattr(op, "trim", lambda: calls.append(1))
    h = op.np.arange(5, dtype=op.U)
    rows = [("new", 0, k, pack(h, h.astype(op.np.uint16))) for k in range(2)]
    op._merge(op.pa.Table.from_arrays([op.pa.array(x, t) for x, t in zip(zip(*rows), op.ROWS.types)], schema=op.ROWS))
    assert calls
