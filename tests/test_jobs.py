"""Jobs as table functions."""

import pytest
from ordwell.operators import jobs


def test_jobs_have_schemas_of_their_own(spark):
    def words(text):
        yield from ((k, w) for k, w in enumerate((text or "").split()))

    def sizes(text):
        if text is not None:
            yield (len(text),)

    jobs.register(spark, "test_job", jobs.RowJob("words", "place int, word string", words), jobs.RowJob("sizes", "size long", sizes))
    given = {"t": spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "c")], "id int, text string")}
    rows = lambda sql: sorted(tuple(r) for r in spark.sql(sql, **given).collect())
    assert rows("SELECT id, place, word FROM {t} t, LATERAL test_job('words', t.text)") == [(1, 0, "a"), (1, 1, "b"), (4, 0, "c")]
    assert rows("SELECT id, w.word, s.size FROM {t} t, LATERAL test_job('words', t.text) w, LATERAL test_job('sizes', t.text) s") == [(1, "a", 3), (1, "b", 3), (4, "c", 1)]
    for wrong in ("'no_such'", "t.text"):
        with pytest.raises(Exception, match="names a job"):
            spark.sql(f"SELECT * FROM {{t}} t, LATERAL test_job({wrong}, t.text)", **given).collect()
    with pytest.raises(ValueError, match="two jobs"):
        jobs.register(spark, "twice", jobs.RowJob("a", "x int", words), jobs.RowJob("a", "x int", words))
