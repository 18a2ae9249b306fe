"""d05_new_templates reads every line of every document."""

from loglode.plans import registry


def test_templates_from_any_line(spark, tmp_path):
    texts = {0: "head a\nmore a\nold late line", 1: "head b\nold late line\nold late line\nnew late line\nnew late line", 2: "head a", 3: "head b\nonce\nnew late line"}
    spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(x.pattern, x["count"], x.level) for x in registry.QUERIES["d05_new_templates"](spark, str(tmp_path)).collect()]
    assert got == [("new late line", 3, "INFO"), ("head b", 2, "INFO")]
