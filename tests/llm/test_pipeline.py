import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark, docs):
    before, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.schema.names == docs.schema.names
        assert [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        before = after
        kept.append({r.doc_id for r in after.select("doc_id").collect()})
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for a, b in zip([ids, *kept], kept):
        assert b <= a
    assert kept[1] == kept[0] and len(kept[2]) < len(kept[1]) and len(kept[3]) < len(kept[2]) and len(kept[3]) > 0.5 * len(ids)
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == kept[3]


def test_stages_take_odd_and_no_rows(spark, odd, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0, name
        got = stage(spark, odd, SF)
        assert got.count() > 0, name


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
