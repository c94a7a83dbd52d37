"""Every archive query against its SQL, on the smallest tables; the data source, streams and command line."""

import os

import duckdb
import pytest

from stratabox.plans import catalogue
from stratabox.sources import archive, ingest
from stratabox.sources import format as fmt
from stratabox.sources.tree_log import Change, TreeLog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, tables, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(str(tuple(r)) for r in got.select(*columns).collect())
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert sorted(tables.sql(sql).columns) == columns
        assert rows == sorted(str(r) for r in tables.sql(f"SELECT {', '.join(columns)} FROM ({sql}) q").fetchall())


def test_data_source_round_trip(spark, tmp_path):
    catalogue.ship(spark)
    archive.register(spark)
    rows = ingest.document_rows(spark, SF).repartition(3, "path").selectExpr("path", "partition_type", "uid", "label", "data", "data_hash_algo", "cast(reserve as int) reserve")
    rows.write.format("archive").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("archive").option("view", "data").load(str(tmp_path / "out"))
    assert back.count() == rows.count()
    by_files = archive.view(archive.read_archives(spark, str(tmp_path / "out")), "partitions")
    assert by_files.count() == rows.count()
    with pytest.raises(Exception, match="FileExistsError"):
        rows.write.format("archive").mode("append").save(str(tmp_path / "out"))


def test_failfast(spark):
    broken = spark.createDataFrame([("p", bytearray(b"no archive at all, but long enough"))], "path string, content binary")
    assert archive.view(broken, "diagnostics").first()["kind"] == "BadMagic"
    with pytest.raises(Exception, match="BadMagic"):
        archive.view(broken, "partitions", "FAILFAST").collect()


def test_stream_of_sessions(spark, tmp_path):
    from stratabox.streaming.sessions import session_stream

    catalogue.ship(spark)
    log = TreeLog()
    log.make_root()
    os.mkdir(tmp_path / "in")
    target = tmp_path / "in" / "t.log"
    target.write_bytes(log.data)

    def drain():
        q = session_stream(spark, str(tmp_path / "in")).select("session_seq").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        q.awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert drain() == [1]
    log.apply([Change("put", "f", b"1")])
    target.write_bytes(log.data + b"torn")
    assert drain() == [1, 2]


def test_command_line(tmp_path, capsys):
    from stratabox.cli import main

    f, src = str(tmp_path / "t.log"), tmp_path / "src"
    (src / "d").mkdir(parents=True)
    (src / "d" / "a.txt").write_text("alpha")
    assert main(["mkfs", f]) == 0 and main(["update", f, str(src)]) == 0 and main(["verify", f]) == 0
    (src / "d" / "a.txt").write_text("beta")
    assert main(["update", f, str(src), "--delete"]) == 0
    assert main(["extract", f, str(tmp_path / "old"), "--at", "2"]) == 0
    assert (tmp_path / "old" / "d" / "a.txt").read_text() == "alpha"
    assert main(["cat", f, "d/zz"]) == 1 and main(["log", f]) == 0 and main(["compact-tree", f]) == 0
    g = str(tmp_path / "p.bin")
    with open(g, "wb") as out:
        out.write(fmt.image([fmt.Part(0x10, b"\1" * 16, fmt.encode_label("a"), b"data", reserve=9)]))
    assert main(["keygen", str(tmp_path / "k")]) == 0 and main(["sign", g, "--key", str(tmp_path / "k")]) == 0
    assert main(["verify-sig", g, "--key", str(tmp_path / "k.pub")]) == 0 and main(["compact", g]) == 0 and main(["verify-sig", g]) == 0
    capsys.readouterr()
    assert main(["sign", g, "--key", str(tmp_path / "k")]) == 0 and "nothing to sign" in capsys.readouterr().out
    for command in (["layout", g], ["table", g], ["chain", g], ["findings", g], ["hexdump", g, "--region", "data"], ["hexdump", g, "--range", "0x0+20"], ["html", g, "--output", str(tmp_path / "g.html")], ["info", g]):
        assert main(command) == 0
    assert "Mail" not in (tmp_path / "g.html").read_text() and "partitions" in (tmp_path / "g.html").read_text()
    t = str(tmp_path / "new.log")
    assert main(["create", t, str(src)]) == 0 and main(["get", t, "d/a.txt", "--output", str(tmp_path / "a.out")]) == 0
    assert (tmp_path / "a.out").read_text() == "beta"
    assert main(["sign", t, "--key", str(tmp_path / "k"), "--sig-label", "mine"]) == 0 and main(["verify-sig", t, "--key", str(tmp_path / "k.pub")]) == 0 and main(["verify", t]) == 0
    assert main(["inspect", g]) == 0 and main(["decode", g]) == 0 and main(["keys", g]) == 0


def test_human_sizes_of_long_documents(spark, tmp_path):
    """Documents of 1 MiB and more are in the result; the SQL speaks only of shorter ones."""
    sizes = {0: 5, 1: 1536, 2: 1048575, 3: 1048576, 4: 1572864, 5: 2202010}
    rows = [(k, "x" * n, "en", "s", n) for k, n in sizes.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["label"]: r["size"] for r in catalogue.queries()["human_sizes"](spark, str(tmp_path)).collect()}
    assert got == {"doc-0": "5 B", "doc-1": "1.5 KiB", "doc-2": "1024.0 KiB", "doc-3": "1 MiB", "doc-4": "1.5 MiB", "doc-5": "2.1 MiB"}


def test_decode_nested_by_type(spark, tmp_path):
    """Documents that begin like a record are documents."""
    from stratabox.sources import records as rec

    starts = [m.decode() for m in (rec.NODE_MAGIC, rec.SESSION_MAGIC, rec.KEY_MAGIC, rec.SIGNATURE_MAGIC, rec.CONTAINER_MAGIC)]
    rows = [(k, t, "en") for k, t in enumerate([*(m + " and more" for m in starts), *starts, "plain", "", None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in catalogue.queries()["decode_nested"](spark, str(tmp_path)).select("decoder", "n").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == set(con.sql(f"SELECT decoder, n FROM ({catalogue.oracle_sql()['decode_nested']}) q").fetchall()) == {("container", 1), ("raw", 13)}
