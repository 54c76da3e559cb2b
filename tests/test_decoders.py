"""Readers of foreign records."""

from pyspark.sql import functions as F

from garner.sources.decoders import header_text, html_text, log_lines, part_text, read_dump, run_summaries, split_addresses, text_column


def test_html_and_parts(spark):
    assert html_text("<head><title>t</title></head><p>A &amp; b<br>c</p><script>x()</script><div>d</div>") == "A & b\nc\n\nd"
    assert html_text(None) is None and html_text("") == ""
    assert part_text("é".encode("latin-1"), "utf-8") == "é" and part_text("é".encode(), None) == "é" and part_text(None) is None
    assert part_text(b"\xe9", "no-such-charset") == "é"
    assert header_text("=?utf-8?q?Gr=C3=BC=C3=9Fe?= da") == "Grüßeda" or header_text("=?utf-8?q?Gr=C3=BC=C3=9Fe?= da") == "Grüße da"
    assert header_text(None) is None
    df = spark.createDataFrame([(1, "<p>x</p>"), (2, None)], "id int, m string")
    assert text_column(df, "m", "t", html_text).select("id", "t").collect() == [(1, "x"), (2, None)]


def test_address_lists(spark):
    cases = [('Ann Lee <Ann@x.test>, b@x.test, "Lee, Bob" <b.lee@x.test>', [("Ann Lee", "ann@x.test"), ("", "b@x.test"), ("Lee, Bob", "b.lee@x.test")]), ("", []), (None, []), (" , ", [])]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, h string")
    got = {r["i"]: [tuple(x) for x in r["a"]] for r in df.select("i", split_addresses(F.col("h")).alias("a")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_dump(spark, tmp_path):
    (tmp_path / "posts.js").write_text('window.YTD.posts.part0 = [ {"post": {"id": "1", "text": "a"}}, {"post": {"id": "2", "text": null}} ]')
    got = read_dump(spark, str(tmp_path / "posts.js"), "struct<post:struct<id:string,text:string>>").select("post.*").collect()
    assert got == [("1", "a"), ("2", None)]


def test_run_log(spark):
    lines = ["2024-01-01 10:00:00 INFO r1 update started: go", "2024-01-01 10:00:05 ERROR r1 update failed: no", "junk", None, "2024-01-01 11:00:00 INFO r2 status done: ok"]
    got = run_summaries(log_lines(spark.createDataFrame([(x,) for x in lines], "value string"))).orderBy("run_id").select("run_id", "command", "lines", "errors", "last_event").collect()
    assert got == [("r1", "update", 2, 1, "failed"), ("r2", "status", 1, 0, "done")]
