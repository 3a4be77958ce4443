from graphloom import streaming


def test_degrees_and_table_follow_the_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.txt").write_text("p sp 3 2\na 1 2 1\na 1 3 2\n")
    arcs = streaming.read_arc_stream(spark, str(source))
    query = streaming.running_degrees(arcs).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    try:
        query.processAllAvailable()
        (source / "2.txt").write_text("a 2 3 1\na 1 1 1\n")
        query.processAllAvailable()
        assert {r.id: r.degree for r in spark.table("degrees").collect()} == {1: 3, 2: 1}
    finally:
        query.stop()
    out = str(tmp_path / "out")
    for _ in range(2):
        streaming.grow(arcs, out, str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(out).count() == 4
