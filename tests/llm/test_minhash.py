from brute import jaccard, sha

from strataflow.llm import minhash


def expected(rows):
    """Edited texts of rows with distinct numbers."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        cut = len(t) // 3
        out[i] = (len(t), t[: len(t) - cut] + following[:cut], following)
    return out


def check(df, rows):
    got = {r.doc_id: r for r in minhash.fingerprint_neighbours(df).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    off = []
    by_text = {}
    for i, t in rows:
        n, edited, following = want[i]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha(edited))
        off += [abs(r.near_edited - jaccard(t, edited)), abs(r.near_next - jaccard(t, following))]
        by_text.setdefault(t or "", set()).add(r.fingerprint)
        by_text.setdefault(edited, set()).add(r.edited_fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    return off


def test_equals_brute_force_and_estimates_jaccard(docs, texts):
    off = check(docs, texts)
    assert max(off) < 0.2 and sum(off) / len(off) < 0.03


def test_few_rows_and_unicode(spark, nothing):
    for rows in ([(5, "𝒳é one two three four five six seven")], [(1, ""), (2, None), (3, "abc" * 5), (9, "é" * 7)]):
        check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert minhash.fingerprint_neighbours(nothing).count() == 0


def test_odd_rows_have_one_row_each(odd):
    got = minhash.fingerprint_neighbours(odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    assert len({r.fingerprint for r in got if r.doc_id in (7, 8)}) == 1


def test_pieces_do_not_matter(docs):
    few, many = (sorted(minhash.fingerprint_neighbours(docs, n).collect()) for n in (1, 23))
    assert few == many


def test_similar_pairs_equal_brute_force(docs, texts):
    left = docs.filter("doc_id % 5 = 0")
    got = {(r.left_id, r.right_id): r.similarity for r in minhash.similar_pairs(left, docs).collect()}
    first = {}
    for i, t in sorted(texts):
        first.setdefault(t, i)
    first_left = {}
    for i, t in sorted(texts):
        if i % 5 == 0:
            first_left.setdefault(t, i)
    want = {(i, j): jaccard(s, t) for s, i in first_left.items() for t, j in first.items() if jaccard(s, t) >= 0.8}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)
