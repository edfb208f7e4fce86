from datetime import datetime, timedelta

from tessera.operators import incremental
from tessera.sources import importing, sinks
from tessera.streaming import twins

START = datetime(2025, 1, 1)


def test_import_tree_links_and_text(spark, tmp_path):
    for path, text in {"space/a.md": "# Title A\n[b](sub/b.html#x) [out](https://x.y) ![i](i.png) [gone](no.md)", "space/sub/b.html": "<title>B &amp; C</title><p>one<br>two</p><script>x</script><a href='../a.md'>a</a>", "space/sub/deep/c.md": "text"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = importing.read_files(spark, str(tmp_path))
    parsed = importing.parse_files(files)
    got = {r.path: r for r in parsed.collect()}
    assert got["space/a.md"].title == "Title A" and got["space/sub/b.html"].title == "B & C" and got["space/sub/b.html"].text == "B & C\none\ntwo\na" or got["space/sub/b.html"].text.endswith("one\ntwo\na")
    assert {tuple(r) for r in importing.page_links(parsed).collect()} == {("space/a.md", "space/sub/b.html"), ("space/sub/b.html", "space/a.md")}
    tree = {r.page: (r.parent, r.level) for r in importing.page_tree(files).collect()}
    assert tree == {"space": (None, 0), "space/a": ("space", 1), "space/sub": ("space", 1), "space/sub/b": ("space/sub", 2), "space/sub/deep": ("space/sub", 2), "space/sub/deep/c": ("space/sub/deep", 3)}


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, t string")
    new = spark.createDataFrame([("b", 2, "z"), ("b", 3, "w"), ("c", 1, "q")], "k string, v int, t string")
    assert {tuple(r) for r in sinks.upserted(old, new, ["k"], "v").collect()} == {("a", 1, "x"), ("b", 3, "w"), ("c", 1, "q")}
    assert {tuple(r) for r in sinks.replaced(old, new.where("k = 'c'"), ["k"], new).collect()} == {("a", 1, "x"), ("c", 1, "q")}


def events(spark):
    rows = [(k, START + timedelta(minutes=m), v) for k, m, v in [("a", 0, "x"), ("a", 5, "x"), ("a", 70, "y"), ("a", 300, "y"), ("b", 1, ""), ("b", 2, "z"), ("b", 2000, "z")]]
    return spark.createDataFrame(rows, "k string, ts timestamp, v string")


def stream(spark, tmp_path, df, build):
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    out = build(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    name = f"q{abs(hash(str(tmp_path)))}"
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


def test_cooldown_batch_and_stream(spark, tmp_path):
    df = events(spark)
    batch = {tuple(r) for r in incremental.cooldown(df, ["k"], "ts", 3600).collect()}
    assert {(k, (t - START).total_seconds() // 60) for k, t, _ in batch} == {("a", 0), ("a", 70), ("a", 300), ("b", 1), ("b", 2000)}
    assert stream(spark, tmp_path, df, lambda s: twins.cooldown_stream(s, "k", "ts", 3600, "1 day")) == batch


def test_changes_batch_and_stream(spark, tmp_path):
    df = events(spark)
    batch = {tuple(r) for r in incremental.changed(df, ["k"], [df.ts], "v").collect()}
    assert {(k, v) for k, _, v in batch} == {("a", "x"), ("a", "y"), ("b", "z")}
    assert stream(spark, tmp_path, df, lambda s: twins.changed_stream(s, "k", "ts", "v")) == batch


def test_debounce_batch_and_stream(spark, tmp_path):
    df = events(spark)
    batch = {tuple(r) for r in incremental.debounce(df, ["k"], "ts", "1 hour").collect()}
    assert len(batch) == 5
    got = stream(spark, tmp_path, df, lambda s: twins.debounce_stream(s, ["k"], "ts", "1 hour", "1 hour"))
    assert got <= batch and len(got) >= 4  # the last burst waits for the watermark
