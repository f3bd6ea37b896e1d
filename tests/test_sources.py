import pytest

from tarnlake import config, sources
from tarnlake.plans import publish


def test_csv_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text("sku,empty,day,big,flag\n00123,,2024-01-02,3000000000,true\n00124,,2024-01-03,1,false\n")
    got = dict(sources.read_csv(spark, str(tmp_path / "t.csv")).dtypes)
    assert got == {"sku": "int", "empty": "string", "day": "date", "big": "bigint", "flag": "boolean"}
    told = sources.read_csv(spark, str(tmp_path / "t.csv"), "sku string, empty string, day date, big bigint, flag boolean")
    assert told.first()["sku"] == "00123" and told.first()["empty"] is None
    assert sources.read_tables(spark, str(tmp_path), ["t"])["t"].count() == 2


def test_snapshots(spark, tmp_path):
    base = tmp_path / "snap base"
    for folder, names in {"2024/01/01/100000": ["a.parquet", "b.parquet"], "2024/01/02/090000": ["b.parquet"]}.items():
        (base / folder).mkdir(parents=True)
        for n in names:
            spark.range(len(folder) + len(names)).toPandas().to_parquet(base / folder / n)
    (base / "stray.txt").write_text("x")
    assert sources.latest_snapshot(spark, str(base)) == "2024/01/02/090000"
    assert sources.latest_snapshot(spark, str(base), "a.parquet") == "2024/01/01/100000"
    assert sources.read_snapshot(spark, str(base), "a.parquet").count() == 19
    with pytest.raises(FileNotFoundError):
        sources.latest_snapshot(spark, str(base), "c.parquet")


def test_listings(spark, tmp_path):
    (tmp_path / "raw/x").mkdir(parents=True)
    (tmp_path / "raw/x/f.bin").write_bytes(b"123")
    (tmp_path / "raw/g.bin").write_bytes(b"1")
    assert sorted(r["length"] for r in sources.list_files(spark, str(tmp_path)).collect()) == [1, 3]
    got = {r["name"]: r["is_directory"] for r in sources.directory_listing(spark, str(tmp_path / "raw")).collect()}
    assert got == {"x": True, "g.bin": False}
    assert sources.container_listing(spark, str(tmp_path)).collect() == [("raw",)]


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = sources.from_rows(spark, [("spark", 1), ("spark", 2)], "origin string, status int")
    for _ in range(2):
        got = publish(spark, {"scratch": rows}, url)
    assert got.collect() == [("scratch", 2, 2, True)]
    back = sources.read_jdbc(spark, url, "scratch")
    assert back.filter("status = 1").count() == 1
    assert sources.read_jdbc(spark, url, query="SELECT 1 AS one FROM SYSIBM.SYSDUMMY1").first()[0] == 1
    assert sources.schema_exists(spark, url, "APP", "derby") and not sources.schema_exists(spark, url, "NOPE", "derby")
    with pytest.raises(ValueError):
        sources.read_jdbc(spark, url)


def test_jdbc_in_parts(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(1000).selectExpr("id - 10 AS id", "CAST(id AS string) AS s").union(spark.createDataFrame([(None, "none")], "id bigint, s string"))
    assert publish(spark, {"big": rows}, url, connections=3, batch_size=100, attempts=2).collect() == [("big", 1001, 1001, True)]
    for how in ({"table": "big"}, {"query": 'SELECT "id", "s" FROM big'}):
        back = sources.read_jdbc(spark, url, **how, parts=sources.Parts("id", 0, 900, 4), fetch_size=50)
        assert back.rdd.getNumPartitions() == 4 and sorted(back.collect(), key=repr) == sorted(rows.collect(), key=repr)
    with pytest.raises(Exception, match="(?i)no suitable driver|not found|refused"):
        publish(spark, {"big": rows}, "jdbc:nothing:x", attempts=2)


def test_config(tmp_path):
    with pytest.raises(config.MissingSettings, match="DB_DATABASE, DB_PASSWORD"):
        config.Database.from_env({"DB_HOST": "h", "DB_USER": "u"})
    db = config.Database.from_env({"DB_HOST": "h", "DB_USER": "u", "DB_DATABASE": "d", "DB_PASSWORD": "p"})
    assert db.url().startswith("jdbc:sqlserver://h:1433;databaseName=d;encrypt=true;") and "p" not in repr(db).split("password")[0][-2:]
    (tmp_path / ".env").write_text("# c\nA=1\nexport B='two'\n\n")
    assert config.read_env_file(str(tmp_path / ".env")) == {"A": "1", "B": "two"}
    assert "fs.azure.account.auth.type.x.dfs.core.windows.net" in config.oauth_options("x", "t", "c", "s")
