"""Readers, gates and stamped datasets."""

import gzip
import json

import pytest
from pyspark.sql import functions as F, types as T

from decklake.sources import ingest as I, materialise as W


def gz(path, text):
    with gzip.open(path, "wt") as f:
        f.write(text)
    return str(path)


def test_games_gate(spark, tmp_path):
    good = I.read_games(spark, gz(tmp_path / "a.csv.gz", "expansion,event_type,won\nFIN,PremierDraft,True\nFIN,PremierDraft,False\nFIN,PremierDraft,True\n"))
    assert I.store_games(good, str(tmp_path / "out"), "FIN", "PremierDraft") == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    for text in ("event_type,won\nPremierDraft,1\n", "expansion,won\nFIN,1\n", "expansion,event_type\nFIN,PremierDraft\nTDM,PremierDraft\n", "expansion,event_type\nFIN,Sealed\n", "expansion,event_type,won\n", "expansion,event_type\n,PremierDraft\n"):
        with pytest.raises(ValueError):
            I.check_markers(I.read_games(spark, gz(tmp_path / "b.csv.gz", text)), "FIN", "PremierDraft")


RATING = T.StructType([T.StructField("name", T.StringType()), T.StructField("ever_drawn_win_rate", T.DoubleType())])


def test_ratings(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"name": "A", "ever_drawn_win_rate": 0.5}, {"name": "B", "ever_drawn_win_rate": None}]))
    rows = I.read_ratings(spark, str(tmp_path / "r.json"), RATING, "FIN", "PremierDraft")
    assert {(r.name, r.expansion) for r in rows.collect()} == {("A", "FIN"), ("B", "FIN")}
    (tmp_path / "e.json").write_text("[]")
    assert I.read_ratings(spark, str(tmp_path / "e.json"), RATING, "FIN", "PremierDraft").count() == 0
    (tmp_path / "o.json").write_text("{}")
    with pytest.raises(ValueError):
        I.read_ratings(spark, str(tmp_path / "o.json"), RATING, "FIN", "PremierDraft")


def test_union_view(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "x"))
    spark.createDataFrame([(2, "z")], "a int, b string").write.parquet(str(tmp_path / "y"))
    assert I.union_view(spark, "games_view", [str(tmp_path / "x"), str(tmp_path / "y")]) == 2
    assert sorted((r.a, r.b) for r in spark.table("games_view").collect()) == [(1, None), (2, "z")]
    assert I.union_view(spark, "games_view", []) == 0 and not spark.catalog.tableExists("games_view")


def test_json_lines(spark, tmp_path):
    schema = T.StructType([T.StructField("name", T.StringType())])
    assert I.read_json_lines(spark, gz(tmp_path / "a.gz", '{"name": "A"}\n\n{"name": "B"}\n'), schema).count() == 2
    for text, said in (('{"name": "A"}\n[1]\n', "line 2"), ('{"name": "A"\n', "line 1"), ("\n", "no lines")):
        with pytest.raises(ValueError, match=said):
            I.read_json_lines(spark, gz(tmp_path / "b.gz", text), schema)


def test_unpivot_and_hands(spark):
    wide = spark.createDataFrame([("d", 1, None, 2, "1|2", ""), ("e", 3, 0, 0, "3", "4")], "draft string, deck_Axe int, deck_Bow int, opening_hand_Axe int, candidate_hand_1 string, candidate_hand_2 string").withColumn("m", F.lit(1))
    rows = I.long_cards(wide, ["draft"], {"deck": "deck_", "hand": "opening_hand_"}).collect()
    assert sorted((r.draft, r.zone, r.card, r.n) for r in rows) == [("d", "deck", "Axe", 1), ("d", "hand", "Axe", 2), ("e", "deck", "Axe", 3)]
    hands = I.candidate_hands(wide, ["draft"], ["candidate_hand_1", "candidate_hand_2"], "m").collect()
    assert sorted((r.draft, r.mulligan_number, r.was_kept) for r in hands) == [("d", 0, False), ("e", 0, False), ("e", 1, True)]


def test_gate_order(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (0, 5)], "a int, b int")
    got = [r.reject_reason for r in I.ordered_gate(df, {"no_b": F.col("b").isNull(), "a": F.col("a") == 1}).collect()]
    assert got == ["no_b", "a", None]


def rows(spark, games, expansion="TLA"):
    return spark.createDataFrame([(g, expansion, "PremierDraft", float(g)) for g in games], "game_id long, expansion string, event_type string, x double")


def test_stamped_dataset(spark, tmp_path):
    path, stamp = "file://" + str(tmp_path / "features"), W.Stamp("s1", "f1", 200)
    assert W.write_stamped(rows(spark, range(5)), path, stamp) == {"rows": 5, "partitions": 1}
    with pytest.raises(FileExistsError):
        W.write_stamped(rows(spark, range(5)), path, stamp)
    assert W.write_stamped(rows(spark, range(8)), path, stamp, "resume", ["game_id"])["rows"] == 3
    assert spark.read.parquet(f"{path}/data").count() == 8
    with pytest.raises(ValueError, match="features f1 is not f2"):
        W.write_stamped(rows(spark, range(9)), path, W.Stamp("s1", "f2", 200), "resume", ["game_id"])
    W.write_stamped(rows(spark, range(2), "SOS"), path, stamp, "overwrite")
    assert {(r.expansion, r.state) for r in W.stamp_report(spark, path, stamp).collect()} == {("TLA", "same"), ("SOS", "same")}
    assert spark.read.parquet(f"{path}/data").count() == 10  # only the partitions written are replaced


def test_migration_is_idempotent(spark):
    before = spark.createDataFrame([("TMT", 1.0), ("TLA", 0.0), ("ZZZ", 0.0)], "expansion string, set_code_TMT double")
    once = W.migrate_one_hots(before, "expansion", ["TMT", "TLA"])
    twice = W.migrate_one_hots(once, "expansion", ["TMT", "TLA"])
    assert once.columns == twice.columns == ["expansion", "set_code_TMT", "set_code_TLA"] and once.collect() == twice.collect()
    assert W.migration_check(before, once, "expansion", ["TMT", "TLA"]) == {"rows": 3, "out_of_vocabulary": 1, "columns": 2}
    stamps = spark.createDataFrame([("a", "3"), ("b", "2"), ("c", None), ("d", "0")], "p string, features string")
    assert [r.state for r in W.classify_for_migration(stamps, "3", ["2"]).orderBy("p").collect()] == ["skipped_at_target", "patched", "skipped_legacy", "refused"]


def test_replay_scan_reads_what_the_header_has(spark, tmp_path):
    path = gz(tmp_path / "r.csv.gz", "draft_id,won,candidate_hand_1,deck_Axe,deck_Bow,junk\nd,True,1|2,2,,x\ne,False,3,1,oops,y\n")
    rows = I.scan_replays(spark, path, ["draft_id", "candidate_hand_1", "candidate_hand_2"])
    assert rows.columns == ["draft_id", "candidate_hand_1", "deck_Axe", "deck_Bow"]
    assert sorted((r.draft_id, r.deck_Axe, r.deck_Bow) for r in rows.collect()) == [("d", 2, None), ("e", 1, None)]
    with pytest.raises(ValueError, match="begins with"):
        I.scan_replays(spark, gz(tmp_path / "n.csv.gz", "draft_id\nd\n"), ["draft_id"])


def test_newest_snapshot(spark, tmp_path):
    for name in ("cards-20240101.jsonl.gz", "cards-20240301.jsonl.gz", "cards-20240201.jsonl.gz", "notes.txt"):
        gz(tmp_path / name, "{}")
    assert I.newest_snapshot(spark, str(tmp_path)).endswith("cards-20240301.jsonl.gz")
    with pytest.raises(ValueError):
        I.newest_snapshot(spark, str(tmp_path), ".csv")


def test_invalidation_rewrites_what_loses_rows(spark, tmp_path):
    path = "file://" + str(tmp_path / "d")
    rows(spark, range(6)).unionByName(rows(spark, range(10, 12), "SOS")).unionByName(rows(spark, [20], "FIN")).write.partitionBy(*W.PARTITION).parquet(path)
    report = W.invalidate(spark, path, spark.createDataFrame([(1,), (4,), (20,), (99,)], "game_id long"), ["game_id"])
    assert {(r.expansion, r.deleted, r.kept) for r in report.collect()} == {("TLA", 2, 4), ("FIN", 1, 0)}
    assert sorted(r.game_id for r in spark.read.parquet(path).collect()) == [0, 2, 3, 5, 10, 11]


def test_the_bad_lines_own_number(spark, tmp_path):
    """Of several files, the first bad line is named by its file and its number there."""
    for name, lines in (("a", ['{"x": 1}'] * 50), ("b", ['{"x": 1}', "", '{"x": 2}', "nothing", '{"x": 3}']), ("c", ["[1]"])):
        with gzip.open(tmp_path / f"{name}.jsonl.gz", "wt") as file:
            file.write("\n".join(lines) + "\n")
    with pytest.raises(ValueError, match=r"b\.jsonl\.gz: line 4 is not an object"):
        I.read_json_lines(spark, f"file://{tmp_path}", T.StructType([T.StructField("x", T.IntegerType())]))


def test_type_flags_are_forced(spark):
    """Each flag by its type, off and on before, null lists and null flags; twice is once."""
    from decklake.operators import catalogue as C

    kinds = "card_id int, types array<string>, subtypes array<string>, is_creature boolean, planeswalker boolean, is_land boolean, equipment boolean, vehicle boolean, burn boolean, is_other boolean"
    rows = [(1, ["Creature", "Artifact"], ["Golem"], False, False, False, False, False, False, True), (2, ["Planeswalker"], None, None, None, None, None, None, None, True), (3, ["Land"], [], False, False, False, False, False, False, False),
            (4, ["Artifact"], ["Equipment"], False, False, False, False, False, False, False), (5, ["Artifact"], ["Vehicle"], False, False, False, False, False, False, False), (6, None, None, True, False, False, False, False, False, True), (7, ["Instant"], None, False, False, False, False, False, True, True), (8, ["Instant"], None, False, False, False, False, False, False, False)]
    once = C.with_invariants(spark.createDataFrame(rows, kinds), ["burn"])
    flags = ["is_creature", "planeswalker", "is_land", "equipment", "vehicle", "burn", "is_other"]
    got = {r.card_id: ([f for f in flags if r[f]], r.modes) for r in once.collect()}
    assert got == {1: (["is_creature"], ["cast"]), 2: (["planeswalker"], ["cast"]), 3: (["is_land"], []), 4: (["equipment"], ["cast"]), 5: (["vehicle"], ["cast"]), 6: (["is_creature"], ["cast"]), 7: (["burn"], ["cast"]), 8: (["is_other"], ["cast"])}
    assert sorted(map(tuple, C.with_invariants(once, ["burn"]).select("card_id", *flags).collect())) == sorted(map(tuple, once.select("card_id", *flags).collect()))


def lost(*_):
    raise RuntimeError("the driver is lost")


def test_a_cut_write_leaves_old_or_new_rows(spark, tmp_path, monkeypatch):
    """Lost before the note of moves: the old rows; lost after it, or amid the moves: the new ones.  Never a hole."""
    path, stamp = "file://" + str(tmp_path / "d"), W.Stamp("s1", "f1", 200)
    both = lambda n: rows(spark, range(n)).unionByName(rows(spark, range(100, 100 + n), "Brand#1"))
    W.write_stamped(both(6), path, stamp)
    read = lambda: sorted(r.game_id for r in W.open_dataset(spark, path).collect())
    old = [*range(6), *range(100, 106)]
    gone = spark.createDataFrame([(1,), *[(g,) for g in range(100, 106)]], "game_id long")
    for act, new in ((lambda: W.invalidate(spark, path, gone, ["game_id"]), [0, 2, 3, 4, 5]), (lambda: W.write_stamped(both(7), path, stamp, "overwrite"), [*range(7), *range(100, 107)]), (lambda: W.write_stamped(both(9), path, W.Stamp("s1", "f1", 200), "resume", ["game_id"]), [*range(9), *range(100, 109)])):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(W, "_publish", lost)
            act()
        assert read() == old
        calls = []

        def second(spark, old, new, rename=W._rename):
            calls.append(new)
            if len([c for c in calls if not c.endswith("/ready")]) == 2:
                lost()
            rename(spark, old, new)

        with monkeypatch.context() as m:
            m.setattr(W, "_rename", second)
            try:
                act()
            except RuntimeError:
                pass
        assert read() == new
        assert [n for n in W._names(spark, path) if n.startswith("_")] == []
        assert {r.state for r in W.stamp_report(spark, path, stamp).collect()} == {"same"}
        old = new


def test_null_and_odd_partitions_are_invalidated(spark, tmp_path):
    path = "file://" + str(tmp_path / "d")
    rows(spark, range(3), None).unionByName(rows(spark, range(10, 12), "a/b c=%")).write.partitionBy(*W.PARTITION).parquet(path)
    report = W.invalidate(spark, path, spark.createDataFrame([(1,), (10,), (11,), (None,)], "game_id long"), ["game_id"])
    assert {(r.expansion, r.deleted, r.kept) for r in report.collect()} == {(None, 1, 2), ("a/b c=%", 2, 0)}
    assert sorted(r.game_id for r in spark.read.parquet(path).collect()) == [0, 2]


def test_buckets_spare_the_stored_side_its_shuffle(spark, tmp_path):
    """Resume, reuse and invalidation by the buckets' key: an exchange of the new side only, before and after an append."""
    path, stamp = "file://" + str(tmp_path / "d"), W.Stamp("s1", "f1", 200)
    W.write_stamped(rows(spark, range(0, 60, 2)).unionByName(rows(spark, range(100, 120), "SOS")), path, stamp, buckets=W.Buckets(("game_id",), 4))
    W.write_stamped(rows(spark, range(0, 60)), path, stamp, "resume", ["game_id"])
    with pytest.raises(ValueError, match="other buckets"):
        W.write_stamped(rows(spark, [999]), path, stamp, "resume", ["game_id"], buckets=W.Buckets(("game_id",), 8))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = W.open_dataset(spark, path)
        assert sorted(r.game_id for r in done.collect()) == [*range(60), *range(100, 120)]
        todo = rows(spark, range(50, 70)).withColumnRenamed("x", "y")
        left = W.resume(todo, done, ["game_id"])
        hits, misses = W.reuse_or_compute(todo, done.select("game_id", "x"), ["game_id"], F.col("game_id") < 58)
        for df, n in ((left, 1), (hits, 1), (misses, 1)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(") == n and "Bucketed: true" in plan, plan
        assert sorted(r.game_id for r in left.collect()) == list(range(60, 70))
        assert sorted((r.game_id, r.x) for r in hits.collect()) == [(g, float(g)) for g in range(50, 58)]
        assert sorted(r.game_id for r in misses.collect()) == list(range(58, 70))
        W.invalidate(spark, path, spark.createDataFrame([(3,), (101,)], "game_id long"), ["game_id"])
        again = W.open_dataset(spark, path)
        assert sorted(r.game_id for r in again.collect()) == [g for g in [*range(60), *range(100, 120)] if g not in (3, 101)]
        assert "Bucketed: true" in W.resume(todo, again, ["game_id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
