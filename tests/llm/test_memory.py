import pytest

import corpus_pipeline
from strandflow.llm import common, decontaminate


def test_a_task_gives_memory_back_at_its_end(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    assert list(common.lean(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4] and given == [1]

    def fails(batches):
        yield next(batches)
        raise ValueError

    with pytest.raises(ValueError):
        list(common.lean(fails)(iter([1])))
    assert given == [1, 1]
    common.give_back()


def test_documents_pass_decontamination_in_batches_of_few_rows(spark, monkeypatch):
    most, cut = common.ARROW_ROWS, decontaminate.sub_batches

    def checked(batches, text_at, most_bytes):
        def each():
            for batch in batches:
                assert batch.num_rows <= most, batch.num_rows
                yield batch

        return cut(each(), text_at, most_bytes)

    monkeypatch.setattr(decontaminate, "sub_batches", checked)
    df = spark.range(0, 3 * most, 1, 1).selectExpr("id AS doc_id", "concat('word ', id) AS text", "'a' AS source")
    assert corpus_pipeline.clean_of_benchmark(spark, df, "/root/testdata/sf0.001").count() == 3 * most
