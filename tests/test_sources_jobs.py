import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldpulse import schemas
from fieldpulse.functions import vocabulary
from fieldpulse.plans import jobs
from fieldpulse.sources import files, incremental, sinks
from fieldpulse.sources.catalog import DATASETS, Catalog
from fieldpulse.sources.database import QUERIES, Database
from fieldpulse.sources.literals import literal_table


def test_ragged_and_bad_fields(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "PlayKey,time,event,x,y,dir,dis,o,s\n"
        "1-1-1,0.0,,1.5,2,10,0,20,0,surplus,more\n"
        "1-1-1,bad,huddle,1.5,2,10,0,20,0\n"
        "1-1-1,0.2,,1.5\n"
    )
    rows = files.read_csv(spark, str(path), schemas.TRACKING).collect()
    assert [(r["time"], r["event"], r["x"], r["y"]) for r in rows] == [
        (0.0, None, 1.5, 2.0), (None, "huddle", 1.5, 2.0), (0.2, None, 1.5, None)]
    few = files.read_csv(spark, str(path), schemas.TRACKING, ["PlayKey", "x"])
    assert few.columns == ["PlayKey", "x"]
    assert files.sample_rows(few, ["x"], 2).count() == 2


def test_damaged_lines_leave_a_trace(spark, tmp_path):
    schema = StructType.fromDDL("id int, day date, name string")
    (tmp_path / "a.csv").write_text('id,day,name\n1,2020-01-02,x\n\nx,2020-13-01,"a,b"\n2,,\n')
    (tmp_path / "b.csv").write_text("id,day,name\n3,2020-01-03\n4,2020-01-04,y,z\n 5 ,2020-01-05,\n")
    lines = files.read_lines(spark, str(tmp_path / "*.csv"))
    parsed = files.parsed_lines(lines, schema)
    sound, damaged = sinks.write_with_quarantine(parsed, str(tmp_path / "out"))
    assert sorted((r.source, r.id, r.day and r.day.day, r.name) for r in sound.collect()) == [
        ("a.csv", 1, 2, "x"), ("a.csv", 2, None, None), ("b.csv", 5, 5, None)
    ]
    assert sorted((r.source, r.id, r.name, r.damage, r.raw) for r in damaged.collect() if r.id) == [
        ("b.csv", 3, None, "missing fields", "3,2020-01-03"),
        ("b.csv", 4, "y", "surplus fields", "4,2020-01-04,y,z"),
    ]
    other = [tuple(r) for r in damaged.filter("id is null").collect()]
    assert other == [("a.csv", None, None, "a,b", "id: x; day: 2020-13-01", 'x,2020-13-01,"a,b"')]


def test_contract_is_checked_in_the_write(spark, tmp_path):
    schema = StructType.fromDDL("PlayKey string, n smallint, t double")
    df = spark.createDataFrame([("a", 1, "1.5"), ("b", 70_000, "x"), ("c", None, None)], "PlayKey string, n int, t string")
    with pytest.raises(ValueError, match="'n': 1"):
        sinks.write_by_contract(df, str(tmp_path / "strict"), schema)
    assert sinks.write_by_contract(df, str(tmp_path / "lax"), schema, lost=2) == {"rows": 3, "n": 1, "t": 1}
    back = spark.read.parquet(str(tmp_path / "lax"))
    assert back.schema == schema and sorted(str(r.n) for r in back.collect()) == ["1", "None", "None"]
    with pytest.raises(ValueError, match="missing"):
        sinks.write_by_contract(df.drop("t"), str(tmp_path / "none"), schema)


def test_files_by_prefix(spark, tmp_path):
    for name in ("NGS-2016-pre.csv", "NGS-2017-reg.csv", "other.csv"):
        (tmp_path / name).write_text("GSISID,Number,Position\n7,80,WR\n")
    df = files.read_prefix(spark, str(tmp_path), "NGS-", "csv", schemas.PUNT_DATA, source="source")
    assert sorted(r["source"] for r in df.collect()) == ["NGS-2016-pre", "NGS-2017-reg"]
    sinks.write_by_source(df, str(tmp_path / "out"))
    assert (tmp_path / "out" / "source=NGS-2016-pre").is_dir()
    with pytest.raises(ValueError):
        files.read_prefix(spark, str(tmp_path), "NGS-")
    with pytest.raises(ValueError):
        files.read_prefix(spark, str(tmp_path), "NGS-", "orc", schemas.PUNT_DATA)


def test_parquet_and_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([(7, "80", "WR"), (8, "20", None)], schemas.PUNT_DATA)
    for _ in range(2):
        sinks.write_parquet(df, str(tmp_path / "p"))
        sinks.write_csv(df, str(tmp_path / "c"))
    assert files.read_parquet(spark, str(tmp_path / "p"), ["GSISID"]).count() == 2
    back = files.read_csv(spark, str(tmp_path / "c"), schemas.PUNT_DATA)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_tables(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("7;80;WR\n8;20;CB\n")
    sinks.load_table(spark, str(path), "punt_positions", schemas.PUNT_DATA, ";", header=False)
    loaded = spark.table("punt_positions")
    assert loaded.count() == 2
    with pytest.raises(ValueError):
        sinks.write_table(loaded.select("Position"), "contracted", schemas.BODY)
    whole = loaded.selectExpr("Position", "'x' AS extra", "2 AS Height_m", "1 AS Weight_kg", "0 AS Chest_rad_m")
    sinks.write_table(whole, "contracted", schemas.BODY)
    row = spark.table("contracted").first()
    assert list(row.asDict()) == ["Position", "Height_m", "Weight_kg", "Chest_rad_m"] and row["Height_m"] == 2.0
    spark.sql("DROP TABLE punt_positions")
    spark.sql("DROP TABLE contracted")


def test_output_contracts(spark):
    summary = spark.createDataFrame([("k", "300", -5)], "PlayKey string, Temperature string, Score_Difference int")
    for contract in (schemas.TRACKING_TABLE, schemas.CONCUSSION_SUMMARY_TABLE, schemas.INJURY_SUMMARY_TABLE):
        with pytest.raises(ValueError):
            schemas.conform(summary, contract)
        assert schemas.conform(summary, contract, contract.names).schema.names == contract.names
    contract = schemas.CONCUSSION_SUMMARY_TABLE
    row = schemas.conform(summary, contract, contract.names).first()
    assert (row["Score_Difference"], row["Temperature"]) == (-5, 300.0)
    odd = spark.createDataFrame([("k", "warm", 70_000), ("k", None, 1)], summary.schema)
    lost = schemas.failed_casts(odd, contract).first()
    assert (lost["PlayKey"], lost["Temperature"], lost["Score_Difference"]) == (0, 1, 1)


def test_csv_header_must_match(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "t.csv").write_text("y,x\n1,2\n")
    schema = StructType().add("x", "double").add("y", "double")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(tmp_path / "t.csv"), schema).collect()
    good = files.read_csv(spark, str(tmp_path / "t.csv"), StructType().add("y", "double").add("x", "double"))
    assert good.select("x").first()["x"] == 2.0


def test_large_dataset_needs_bounds(spark):
    with pytest.raises(ValueError):
        Database("jdbc:none:").named(spark, "ngs_data")


def test_catalog_names(spark, tmp_path):
    assert set(DATASETS) >= {"plays", "injuries", "role_data", "punt_data", "play_information", "game_data", "video_review"}
    with pytest.raises(ValueError):
        Catalog(str(tmp_path)).load(spark, "weather_station")


def test_database_names(spark):
    assert len(QUERIES) == 8
    with pytest.raises(ValueError):
        Database("jdbc:none:").named(spark, "other")


def test_literal_table_is_local(spark):
    df = literal_table(spark, vocabulary.BODY, schemas.BODY)
    assert "LocalTableScan" in df._jdf.queryExecution().toString()
    assert literal_table(spark, [], schemas.BODY).count() == 0


# Whole jobs on small source files.


def write(path, header, rows):
    path.write_text("\n".join([header, *[",".join("" if v is None else str(v) for v in r) for r in rows]]) + "\n")


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    root = tmp_path_factory.mktemp("source")
    rng = random.Random(2)

    def path_rows(n):
        x, y = rng.uniform(0, 100), rng.uniform(0, 50)
        for i in range(n):
            x, y = x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)
            yield i, round(x, 2), round(y, 2), round(rng.uniform(0, 360), 2), round(rng.uniform(0, 360), 2)

    keys = ["1-1-1", "1-1-2", "2-1-1", "3-1-1"]
    rows = [(k, i / 10, None, x, y, d, 0, o, 0) for k in keys for i, x, y, d, o in path_rows(20)]
    rng.shuffle(rows)
    write(root / "PlayerTrackData.csv", "PlayKey,time,event,x,y,dir,dis,o,s", rows)
    write(root / "PlayList.csv", ",".join(schemas.PLAYS.names), [
        (1, "1-1", "1-1-1", "WR", 1, 1, "Domed", "Natural", 60, None, "Pass", 1, "WR", "WR"),
        (1, "1-1", "1-1-2", "WR", 1, 1, None, "Natural", 75, None, "Rush", 2, "WR", "WR"),
        (2, "2-1", "2-1-1", "CB", 1, 1, "Open", "Synthetic", 50, "Fair", "Punt Returned", 1, "CB", "DB"),
        (3, "3-1", "3-1-1", "X", 1, 1, "Open", "Synthetic", 50, "Fair", "Pass", 1, None, None),
    ])
    write(root / "InjuryRecord.csv", ",".join(schemas.INJURIES.names), [
        (1, "1-1", "1-1-1", "Knee", "Natural", 1, 1, 1, 0), (1, "1-1", "1-1-1", "Foot", "Natural", 1, 0, 0, 0),
        (4, "4-1", None, "Toe", "Natural", 1, 0, 0, 0)])
    for name, play_id in (("NGS-2016-reg", 10), ("NGS-2017-reg", 11)):
        league = [
            (2016, 1, play_id, f"{p}.0", f"2016-09-01 12:00:{i // 10:02d}.{i % 10}00", x, y, 0, o, d, None)
            for p in (7, 8, 9) for i, x, y, d, o in path_rows(15)
        ] + [(2016, 1, play_id, None, "2016-09-01 12:00:00.000", 0, 0, 0, 0, 0, None)]
        rng.shuffle(league)
        write(root / f"{name}.csv", ",".join(schemas.NGS.names), league)
    write(root / "player_punt_data.csv", "GSISID,Number,Position", [(7, 80, "WR"), (7, 81, "WR"), (8, 20, "CB"), (9, 1, None)])
    write(root / "play_player_role_data.csv", ",".join(schemas.ROLE_DATA.names), [
        (2016, 1, play, p, "GL") for play in (10, 11) for p in (7, 8, 9)])
    write(root / "play_information.csv", ",".join(schemas.PLAY_INFORMATION.names), [
        (2016, "Reg", 1, "2016-09-01", 1, play, "10:00", "A 20", 1, "Punt", "A", "A-B", "7 - 10", "text") for play in (10, 11)])
    write(root / "game_data.csv", ",".join(schemas.GAME_DATA.names), [
        (1, 2016, "Reg", 1, "2016-09-01 00:00:00", "Sunday", "Town", "13:00", "A", "HA", "B", "VB", "S", "Dome", "Grass", None, 60, None)])
    write(root / "video_review.csv", ",".join(schemas.VIDEO_REVIEW.names), [
        (2016, 1, 10, 7, "Tackling", "No", "Helmet", "8", "Tackled", "No"), (2017, 1, 11, 8, "Blocking", "No", "Ground", None, None, "No")])
    return str(root)


@pytest.mark.parametrize("limit", [1_000_000, 6])
def test_whole_jobs(spark, source, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(jobs, "PLAY_ROWS", limit)
    out = str(tmp_path)
    catalog = Catalog(source)
    jobs.run_lower_body(spark, catalog, out)
    jobs.run_concussions(spark, catalog, out)
    jobs.run_all_tracking(spark, catalog, out)

    moved = spark.read.parquet(f"{out}/injury_output")
    # The player without a position is left out.
    assert {r["PlayKey"]: r["count"] for r in moved.groupBy("PlayKey").count().collect()} == {
        "1-1-1": 20, "1-1-2": 20, "2-1-1": 20}
    assert spark.read.parquet(f"{out}/TrackingInjuries.parquet").count() == 20
    lower = spark.read.parquet(f"{out}/Summary_Injuries.parquet")
    assert sorted((r["PlayKey"], r["BodyPart"], r["PlayType"]) for r in lower.collect()) == [
        ("1-1-1", "Foot", "Pass"), ("1-1-1", "Knee", "Pass"), ("1-1-2", "No_Injury", "Rush"), ("2-1-1", "No_Injury", "Punt")]
    assert schemas.conform(lower, schemas.INJURY_SUMMARY_TABLE).filter("Distance is null").count() == 0

    tracked = spark.read.parquet(f"{out}/TrackingConcussions.parquet")
    assert {(r["PlayKey"], r["InjuryKey"]): r["count"] for r in tracked.groupBy("PlayKey", "InjuryKey").count().collect()} == {
        ("7-1-10", "7-1-10"): 15, ("8-1-10", "7-1-10"): 15, ("8-1-11", "8-1-11"): 15}
    summary = spark.read.parquet(f"{out}/Summary_Concussions.parquet")
    # One row per jersey number, and per play exactly one roll-up.
    assert summary.count() == 6 and summary.select("PlayKey").distinct().count() == 4

    whole = spark.read.parquet(f"{out}/All_Tracking.parquet")
    assert whole.columns == schemas.ALL_TRACKING_COLUMNS
    assert {r["InjuryType"]: r["count"] for r in whole.groupBy("InjuryType").count().collect()} == {
        "Concussion": 30, "No Injury": 15, "Knee": 20, "Foot": 20}


def test_injured_plays_first_or_last_is_the_same(spark, source):
    catalog = Catalog(source)
    samples, plays, injuries = (catalog.load(spark, n) for n in ("tracking", "plays", "injuries"))
    before = jobs.lower_body_injured(samples, plays, injuries)
    after = jobs.lower_body_mechanics(samples, plays).filter("PlayKey = '1-1-1'")
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))


def test_summary_join_kinds(spark, source):
    catalog = Catalog(source)
    samples, plays, injuries = (catalog.load(spark, n) for n in ("tracking", "plays", "injuries"))
    rolled = jobs.lower_body_summary(samples, plays, injuries)
    assert {"Position", "Position_right"} <= set(rolled.columns)
    described = plays.select("PlayKey", "Position")
    rollups = rolled.select("PlayKey", F.col("Position_right").alias("Position"), "Distance").distinct()
    assert jobs.summarize(described, rollups).count() == 3
    assert jobs.summarize(described, rollups, "left").count() == 4


# Loads that touch only what changed.


def _files_under(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_only_changed_files_are_loaded(spark, tmp_path):
    schema = StructType.fromDDL("id int, name string")
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    for i in range(3):
        (src / f"NGS-{i}.csv").write_text(f"id,name\n{i},a\n{i + 10},b\n")
    (src / "other.csv").write_text("id,name\n99,z\n")

    def load():
        return incremental.load_changed(spark, str(src), "NGS-", schema, str(out))

    def ids():
        return sorted(r.id for r in incremental.loaded_rows(spark, str(out)).collect())

    assert load() == ["NGS-0.csv", "NGS-1.csv", "NGS-2.csv"]
    before = _files_under(out / "rows")
    assert ids() == [0, 1, 2, 10, 11, 12] and load() == [] and _files_under(out / "rows") == before
    (src / "NGS-1.csv").write_text("id,name\n1,a\n21,b\n31,c\n")
    (src / "NGS-3 é.csv").write_text("id,name\n3,a\n")
    assert load() == ["NGS-1.csv", "NGS-3 é.csv"] and ids() == [0, 1, 2, 3, 10, 12, 21, 31]
    after = _files_under(out / "rows")
    kept = {f for f in before if "NGS-1" not in f}
    assert {f: after[f] for f in kept} == {f: before[f] for f in kept}
    # A file that is gone, and one that is empty by now.
    (src / "NGS-0.csv").unlink()
    (src / "NGS-2.csv").write_text("id,name\n")
    assert load() == ["NGS-0.csv", "NGS-2.csv"] and ids() == [1, 3, 21, 31] and load() == []


def test_only_touched_parts_are_updated(spark, tmp_path):
    path = tmp_path / "store"
    table = spark.range(200).selectExpr("cast(id as string) as PlayKey", "cast(null as double) as Time", "id as x")
    incremental.create_store(table, str(path), "PlayKey", 8)
    before = _files_under(path / "rows")
    log = spark.createDataFrame([("7", 1, 2.5), ("7", 2, 3.5), ("unknown", 1, 1.0)], "PlayKey string, seq int, Time double")
    touched = incremental.update_store(spark, str(path), log, "PlayKey", 8)
    assert 1 <= len(touched) <= 2
    after = _files_under(path / "rows")
    kept = {f for f in before if not any(f.startswith(f"part={p}/") for p in touched)}
    assert kept and {f: after[f] for f in kept} == {f: before[f] for f in kept}

    def times():
        rows = incremental.stored_rows(spark, str(path))
        assert rows.count() == 200
        return {r.PlayKey: r.Time for r in rows.filter("Time is not null").collect()}

    assert times() == {"7": 3.5}
    incremental.update_store(spark, str(path), log, "PlayKey", 8)
    assert times() == {"7": 3.5}
    # A run that was broken off before its parts were moved in is finished by the next.
    part = spark.read.parquet(str(path / "rows")).filter(F.col("part") == touched[0])
    part.withColumn("Time", F.lit(9.0)).write.mode("overwrite").parquet(str(path / "pending"))
    n = part.count()
    incremental.update_store(spark, str(path), log.limit(0), "PlayKey", 8)
    assert len([t for t in times().values() if t == 9.0]) == n
    assert spark.read.parquet(str(path / "pending")).isEmpty()


def test_files_are_balanced(spark, tmp_path):
    rows = spark.range(0, 400_000, 1, 16).selectExpr(
        "case when id % 10 < 8 then 'hot' else concat('k', id % 5) end as Position_Play", "rand(1) as v", "uuid() as text"
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    sinks.write_balanced(rows, str(tmp_path / "one"), "Position_Play", target="2MB", folders=True)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
    folders = {}
    for f in (tmp_path / "one").rglob("*.parquet"):
        folders.setdefault(f.parent.name, []).append(f.stat().st_size)
    hot = folders.pop("Position_Play=hot")
    assert len(hot) >= 4 and max(hot) <= 2 * min(hot)
    assert all(len(sizes) <= 2 for sizes in folders.values())
    assert spark.read.parquet(str(tmp_path / "one")).count() == 400_000


def test_league_files_are_read_once(spark, source, tmp_path, monkeypatch):
    """The source files are read where they are landed, and a second run reads none."""
    read = []
    whole = incremental.read_csv
    monkeypatch.setattr(incremental, "read_csv", lambda s, paths, *a: read.append(len(paths)) or whole(s, paths, *a))
    out, catalog = str(tmp_path), Catalog(source)
    first = jobs.run_concussions(spark, catalog, out)
    assert first == {"tracking": 45, "summary": 6} and read == [2]
    assert jobs.run_concussions(spark, catalog, out) == first and read == [2]
    raw, positions, reviews = (catalog.load(spark, n) for n in ("ngs", "punt_data", "video_review"))
    names = schemas.PAIRED_TRACKING_TABLE.names
    direct = jobs.concussion_tracking(raw, positions, reviews).select(*names)
    written = spark.read.parquet(f"{out}/TrackingConcussions.parquet").select(*names)
    assert sorted(map(str, direct.collect())) == sorted(map(str, written.collect()))
