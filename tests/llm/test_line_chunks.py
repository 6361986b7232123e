import random
from collections import defaultdict

import duckdb

from strataflow.llm import line_chunks, queries


def brute(rows):
    """Text and removed lines of each row; equal rows are one document."""
    places = defaultdict(set)
    key = {(i, t): k for k, (i, t) in enumerate(dict.fromkeys(rows))}
    from xxhash import xxh64_intdigest

    def order(i, t):
        h = xxh64_intdigest((t or "").encode(), 42)
        return (i is not None, i or 0, h - (1 << 64) if h >> 63 else h)

    for i, t in key:
        for first, n, chunk in line_chunks.chunks(t or ""):
            places[chunk].add((*order(i, t), first, n, i, t))
    gone = defaultdict(set)
    for found in places.values():
        for *_, first, n, i, t in sorted(found, key=lambda p: p[:4])[1:]:
            gone[i, t] |= set(range(first, first + n))
    out = []
    for i, t in rows:
        g = gone[i, t]
        kept = t if not g else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)
        out.append((str(i), str(kept), len(g)))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), str(r.text), r.removed_lines) for r in df.collect())


def test_equals_brute_force(docs, texts, odd, nothing):
    assert rows_of(line_chunks.remove_repeated(docs)) == brute(texts)
    got = line_chunks.remove_repeated(odd)
    assert got.columns == [*odd.columns, "removed_lines"]
    assert rows_of(got) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert line_chunks.remove_repeated(nothing).count() == 0


def test_equals_sql(docs):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted((str(i), str(t), n) for i, t, n in con.execute(queries.SQL["op3_line_chunks"]).fetchall())
    assert rows_of(line_chunks.remove_repeated(docs)) == want


def test_a_column_of_the_result_s_name_is_replaced(spark):
    df = spark.createDataFrame([(1, "a\nb", "x")], "doc_id long, text string, removed_lines string")
    got = line_chunks.remove_repeated(df)
    assert got.columns == ["doc_id", "text", "removed_lines"] and got.first().removed_lines == 0


def test_boundaries_resist_shifts():
    rng = random.Random(2)
    lines = [f"line {rng.random()}" for _ in range(400)]
    before = {c for _, _, c in line_chunks.chunks("\n".join(lines))}
    after = {c for _, _, c in line_chunks.chunks("\n".join(["new", *lines[:200], "put in", "twice", *lines[200:]]))}
    assert len(before - after) <= 3


def test_long_passages_go_and_single_short_lines_stay(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    one, many, short = line(60), "\n".join(line(14) for _ in range(12)), "just a footer line"
    rows = [(k, "\n".join([line(20), one, line(12), many, line(9), short, line(11)])) for k in range(6)]
    got = {r.doc_id: r.text for r in line_chunks.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for k in range(1, 6):
        assert one not in got[k] and short in got[k]
        left = sum(x in got[k] for x in many.split("\n"))
        assert left <= 8


def test_repeated_passages_go_wholly(spark):
    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    passages = [[line(rng.randint(5, 24) + 24 * (k == 2)) for _ in range(k)] for k in (2, 2, 3, 4, 7, 12) for _ in range(8)]
    passages = [p for p in passages if sum(len(x.split()) for x in p) >= 50]
    assert len(passages) > 25 and min(map(len, passages)) == 2
    rows, alone = [(0, "\n".join(x for p in passages for x in [line(9), *p]))], []
    for p in passages:
        alone.append([line(rng.randint(3, 20)) for _ in range(4)])
        rows.append((len(rows), "\n".join([*alone[-1][:2], *p, *alone[-1][2:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_chunks.remove_repeated(df, whole=True).collect()}
    assert got[0] == (rows[0][1], 0)
    for k, (p, own) in enumerate(zip(passages, alone), 1):
        assert got[k] == ("\n".join(own), len(p))


def test_first_place_of_a_passage_that_repeats_itself_stays_whole(spark):
    line = " ".join(f"w{k}" for k in range(20))
    rows = [(1, "\n".join([line] * 12)), (2, "\n".join(["a b", *[line] * 5]))]
    got = {r.doc_id: r.text for r in line_chunks.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()}
    assert got[1].startswith(line) and got[2] == "a b"


def test_windows_cover_every_passage():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.choice([0, 1, 4, 9, 20, 49, 50, 70]) for _ in range(rng.randint(1, 12))]
        text = "\n".join(" ".join(["w"] * n) for n in sizes)
        runs = [(a, a + n) for a, n, piece in line_chunks.windows(text)]
        for (a, b), (_, _, piece) in zip(runs, line_chunks.windows(text)):
            assert piece.decode() == "\n".join(text.split("\n")[a:b]) and sum(sizes[a:b]) >= 50
        for a in range(len(sizes)):
            for b in range(a + 1, len(sizes) + 1):
                if sum(sizes[a:b]) >= 50:
                    assert {k for x, y in runs if a <= x and y <= b for k in range(x, y)} >= {k for k in range(a, b) if sizes[k]}
