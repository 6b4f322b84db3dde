import corpus_pipeline as C
import __spark_entry__ as E
from terrakiln.llm import registry


def test_stages(spark, documents, odd_rows):
    base = "the words of this clean text stand in many rows and tell a small story about gardens and rivers "
    rows = [*odd_rows, *((100 + i, base * 2 + " ".join(f"word{'abcdefghij'[int(c)]}" for c in str(i * i * 977 + 12345)), "en", "ab"[i % 2]) for i in range(40))]
    docs = documents(rows)
    columns = docs.columns
    assert 4 <= len(C.STAGES) <= 5
    for name, stage in C.STAGES:
        out = stage(spark, docs, "/nowhere")
        if name != C.STAGES[-1][0]:
            assert out.columns == columns
        docs = C.stored(out)
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert docs.count() > 0


def test_stages_on_an_empty_table(spark, empty):
    docs = empty
    for _, stage in C.STAGES:
        docs = C.stored(stage(spark, docs, "/nowhere"))
    assert docs.count() == 0


def test_registered():
    names = E.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)
