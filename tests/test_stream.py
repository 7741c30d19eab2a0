"""The log stream: framing, state, resolution."""

import json
import random

from pyspark.sql import functions as F

from decklake.streaming import log, reservoir, tail as tail_module
from decklake.streaming.tail import TailReader


def state(pending=True, hand=(1, 2), objects=((1, 10), (2, 20)), mulligans=0, active=1, opp=1):
    return {"greToClientEvent": {"greToClientMessages": [{"type": "GREMessageType_GameStateMessage", "systemSeatIds": [1], "gameStateMessage": {
        "gameObjects": [{"instanceId": a, "grpId": b} for a, b in objects], "zones": [{"type": "ZoneType_Hand", "ownerSeatId": 1, "objectInstanceIds": list(hand)}],
        "players": [{"systemSeatNumber": 1, "mulliganCount": mulligans, "pendingMessageType": "ClientMessageType_MulliganResp" if pending else "none"}, {"systemSeatNumber": 2, "mulliganCount": opp}], "turnInfo": {"activePlayer": active}}}]}}


DECK = {"x": json.dumps({"MainDeck": [{"cardId": 10, "quantity": 2}, {"cardId": 20, "quantity": 1}]})}
END = {"matchGameRoomStateChangedEvent": {"gameRoomInfo": {"stateType": "MatchGameRoomStateType_MatchCompleted"}}}


def text(*objects):
    return "junk before\n" + "".join(f"{log.MARKER}2024-01-01 00:00:{i:02d}\n{o if isinstance(o, str) else json.dumps(o, indent=1)}\n" for i, o in enumerate(objects))


def replay(spark, logs, tmp_path):
    cards = spark.createDataFrame([(10, "Ten"), (20, "Twenty")], "id int, name string")
    df = spark.createDataFrame([(s, t) for s, t in logs.items()], "source string, value string")
    key = lambda r: (r.source, r.at or "", r.what)
    live, batch = (sorted(d.collect(), key=key) for d in (log.live(df, cards, f"file://{tmp_path}", 5000), log.replay(df, cards, 5000)))
    assert [r.asDict() for r in live] == [r.asDict() for r in batch]
    return live


def test_decisions(spark, tmp_path):
    a = text(DECK, state(pending=False, hand=(1,), objects=((1, 10),)), state(objects=((2, 20),)), state(), "{\"broken\": " , state(mulligans=1, active=2), END, state(objects=()), DECK)
    b = text(state(active=2))
    c = text(DECK, state(objects=((1, 10), (2, 99))))
    rows = replay(spark, {"a": a, "b": b, "c": c}, tmp_path)
    got = [(r.source, r.what, r.mulligan_count, r.on_the_play, r.opp_mulligan_count, r.hand_names) for r in rows]
    assert got == [
        ("a", "deck_submitted", None, None, None, []),
        ("a", "decision", 0, True, None, ["Ten", "Twenty"]),  # the map is built over messages; the repeat is left out
        ("a", "decision", 1, True, None, ["Ten", "Twenty"]),  # the first active player counts
        ("a", "match_ended", None, None, None, []),  # state is gone: no card is known; the deck is the same
        ("b", "no_deck", 0, False, 1, ["Ten", "Twenty"]),
        ("c", "deck_submitted", None, None, None, []),
        ("c", "hand_unresolved", 0, True, None, ["Ten"]),
    ]
    assert rows[1].deck_names == ["Ten", "Ten", "Twenty"]


def test_json_objects():
    assert log.json_objects('a {bad {"x": {"y": 1}} {"z": 2}') == ['{"x": {"y": 1}}', '{"z": 2}']
    assert log.json_objects("") == []


def test_order_is_the_files_not_the_times(spark, tmp_path):
    """Times without leading zeros, across noon and midnight, several blocks in a second, and headers of every kind."""
    block = lambda at, body: f"{log.MARKER}{at}\n{json.dumps(body)}\n"
    times = ["3/15/2026 9:59:58 AM", "3/15/2026 10:00:01 AM", "3/15/2026 12:30:00 PM", "3/15/2026 12:30:00 PM", "3/15/2026 1:05:00 PM", "3/16/2026 12:00:01 AM"]
    bodies = [DECK, state(mulligans=0), state(mulligans=1), state(mulligans=2), END, state(mulligans=0, active=2)]
    whole = "junk {}\n" + "".join(map(block, times, bodies))
    odd = f"{log.MARKER}3/15/2026 7:23:00 PM {json.dumps(DECK)}\n{log.MARKER}==> Request 5 {json.dumps(state(mulligans=3))}\n{log.MARKER}: Match to X {json.dumps(END)}{log.MARKER}3/15/2026 8:00:00 PM\n{'x' * 6000}\n"
    rows = replay(spark, {"a": whole, "b": odd}, tmp_path)
    got = {(r.source, r.what, r.mulligan_count, r.on_the_play, r.at) for r in rows}
    assert got == {
        ("a", "deck_submitted", None, None, times[0]), *(("a", "decision", k, True, times[k + 1]) for k in range(3)), ("a", "match_ended", None, None, times[4]), ("a", "decision", 0, False, times[5]),
        ("b", "deck_submitted", None, None, "3/15/2026 7:23:00 PM"), ("b", "decision", 3, True, None), ("b", "match_ended", None, None, None), ("b", "oversized_block", None, None, "3/15/2026 8:00:00 PM"),
    }


def test_a_block_goes_to_python_once(spark):
    """All kinds of messages come from one pass, and a card that is listed with copies is one row; states and decks of one object keep their own cards."""
    both = state(objects=((1, 10), (2, 20))) | DECK
    files = spark.createDataFrame([("a", 0, text(both, END) + log.MARKER + "x" * 6000)], "source string, part long, value string")
    events = log.typed_events(log.blocks(files), 5000)
    assert events._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [f"{f.name} {f.dataType.simpleString()}" for f in events.schema] == log.EVENT.replace("long", "bigint").split(", ")
    got = [(r.block, r.message, r.kind, r.id, r.copies, r.hand) for r in events.orderBy("block", "message", F.col("line") < 0, "line").collect()]
    assert got == [(1, 0, None, 10, 1, None), (1, 0, None, 20, 1, None), (1, 0, "state", None, None, [1, 2]), (1, 1, None, 10, 2, None), (1, 1, None, 20, 1, None), (1, 1, "deck", None, None, None), (2, 0, "end", None, None, None), (3, 0, "failure", None, None, None)]


def test_states_before_decks_of_one_object(spark, tmp_path):
    rows = replay(spark, {"a": text(state(objects=((1, 10), (2, 20))) | DECK)}, tmp_path)
    assert {(r.what, tuple(r.hand or ()), tuple(r.deck or ())) for r in rows} == {("no_deck", (10, 20), ()), ("deck_submitted", (), (10, 10, 20))}


def test_logs_are_shuffled_once_as_short_rows(spark):
    """Landing takes the partitions that the logs were made in: texts aren't shuffled."""
    events = spark.sql("SELECT id % 20 AS user_id, timestamp_seconds(1700000000 + id * 977) AS ts, element_at(array('view', 'click', 'purchase', 'error', 'signup'), CAST(id % 5 AS INT) + 1) AS event_type, '{\"k\": 7}' AS props FROM range(500)")
    landed = log._clustered_parts(log.logs_of_events(events))
    landed = landed.mapInPandas(lambda frames: frames, landed.schema)
    assert landed.count() == 500 - landed.select(F.sum(F.size(F.split("value", r"\[Unity")) - 2)).first()[0]
    plan = landed._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 1 and "Exchange" in plan.split("ObjectHashAggregate")[-1]


def test_only_the_ids_of_the_log_are_joined(spark, monkeypatch):
    """A catalogue that Spark would not broadcast is cut to the log's ids, so rows aren't shuffled by a few ids; beyond the bound the plain join gives the same."""
    logs = spark.createDataFrame([(f"s{i}", text(DECK, state(objects=((1, 10), (2, 99 + i))), state(mulligans=1))) for i in range(30)], "source string, value string")
    cards = spark.range(2000).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("n"), "id").alias("name")).filter("id <> 100")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan, rows = [], []
        for most in (log.MOST_NAMED, 0):
            monkeypatch.setattr(log, "MOST_NAMED", most)
            found = log.replay(logs, cards)
            plan.append(found._jdf.queryExecution().executedPlan().toString())
            rows.append(sorted(map(str, found.collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan[0] and "BroadcastHashJoin" not in plan[1]
    assert "hashpartitioning(id" not in plan[0] and "hashpartitioning(id" in plan[1]
    assert rows[0] == rows[1] and len(rows[0]) == 90 and sum("hand_unresolved" in r for r in rows[0]) == 1


def read_new(reader, before):
    """What a batch from offset ``before`` on gives, and its end."""
    end = reader.latestOffset()
    shares = reader.partitions(before, end)
    reader.commit(end)
    return [row for p in shares for row in reader.read(p)], end


def test_a_log_cut_at_every_byte(tmp_path):
    """Whatever two moments a log is looked at, its blocks come whole, once and in order."""
    whole = ("junk\n" + "".join(f"{log.MARKER}7{i}\n{{\"a\": \"é{i}\"}}\n" for i in range(4))).encode()
    parts = whole.decode().split(log.MARKER)[1:]
    path = tmp_path / "a.log"
    for cut in range(len(whole) + 1):
        reader = TailReader({"path": str(tmp_path)})
        path.write_bytes(whole[:cut])
        first, at = read_new(reader, reader.initialOffset())
        again = TailReader({"path": str(tmp_path)})  # a restart in between: nothing but the offset is left
        path.write_bytes(whole)
        second, at = read_new(again, at)
        assert [t for _, _, t in first + second] == parts[:-1], cut
        closed, _ = read_new(TailReader({"path": str(tmp_path), "closed": "true"}), at)
        assert [t for _, _, t in closed] == parts[-1:]
    growing = TailReader({"path": str(tmp_path)})
    at, got = growing.initialOffset(), []
    for cut in range(len(whole) + 1):
        path.write_bytes(whole[:cut])
        rows, at = read_new(growing, at)
        got += rows
    assert [t for _, _, t in got] == parts[:-1] and [b for _, b, _ in got] == sorted({b for _, b, _ in got})


def test_a_log_that_gets_shorter_begins_again(tmp_path):
    block = lambda i, n=1: f"{log.MARKER}at {i}\n{'x' * n}\n"
    path, reader = tmp_path / "a.log", TailReader({"path": str(tmp_path)})
    path.write_text("".join(block(i, 50) for i in range(9)))
    first, at = read_new(reader, {})
    assert len(first) == 8
    path.write_text("".join(block(i) for i in (20, 21, 22)))
    second, at = read_new(reader, at)
    assert [t.split()[1] for _, _, t in second] == ["20", "21"]
    path.write_text("".join(block(i, 90) for i in range(30, 50)))  # replaced by a longer one
    third, at = read_new(reader, at)
    assert [t.split()[1] for _, _, t in third] == [str(i) for i in range(30, 49)]
    path.unlink()
    assert read_new(reader, at) == ([], {})
    path.write_text(block(60) + block(61))
    assert [t.split()[1] for _, _, t in read_new(reader, {})[0]] == ["60"]


def test_shares_and_bounded_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(tail_module, "STEP", 37)
    rng = random.Random(4)
    texts = {f"s{k}": [f"{i} " + "y" * rng.randrange(0, 120) for i in range(rng.randrange(1, 40))] for k in range(5)}
    for name, parts in texts.items():
        (tmp_path / f"{name}.log").write_text("".join(log.MARKER + p for p in parts))
    for share in (1, 40, 1000):
        rows, _ = read_new(TailReader({"path": str(tmp_path), "closed": "true", "share": str(share)}), {})
        assert {n: [t for m, _, t in sorted(rows) if m == n] for n in texts} == texts
    reader = TailReader({"path": str(tmp_path), "closed": "true", "maxbytes": "300"})
    at, batches = reader.initialOffset(), []
    while True:
        rows, at = read_new(reader, at)
        if not rows:
            break
        batches.append(rows)
    assert len(batches) > 5 and max(sum(len(t) for n, _, t in rows if n == "s0") for rows in batches) < 300 + 200
    assert {n: [t for rows in batches for m, _, t in rows if m == n] for n in texts} == texts


def shown(rows):
    return [(r.what, r.hand_names, r.mulligan_count) for r in sorted(rows, key=lambda r: r.seq)]


def test_any_sink_and_restarts(spark, tmp_path):
    """A block whose end comes later, to a running query and to one that starts anew; state, deck and last decision go on; a memory sink has the names."""
    whole = text(DECK, state(), state(), state(mulligans=1), END).encode()
    middle = whole.index(b"MulliganResp")  # inside the first state
    want = [("deck_submitted", [], None), ("decision", ["Ten", "Twenty"], 0), ("decision", ["Ten", "Twenty"], 1)]
    cards = spark.createDataFrame([(10, "Ten"), (20, "Twenty")], "id int, name string")
    (tmp_path / "logs").mkdir()
    path = tmp_path / "logs" / "a.log"
    stream = lambda: log.decisions(log.tailed(spark, f"file://{tmp_path}/logs"), cards, 5000, None, None).writeStream.option("checkpointLocation", f"file://{tmp_path}/state")
    for k, piece in enumerate((whole[:middle], whole)):  # two queries, one after the other
        path.write_bytes(piece)
        query = stream().format("parquet").option("path", f"file://{tmp_path}/out").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        assert shown(spark.read.schema(log.OUT).parquet(f"file://{tmp_path}/out").collect()) == want[: 1 if k == 0 else 3]
    held = spark.read.format("statestore").option("stateVarName", "cards").load(f"file://{tmp_path}/state")
    assert sorted((r[0].instance, r[1].id) for r in held.select("user_map_key", "user_map_value").collect()) == [(1, 10), (2, 20)]
    path.write_bytes(whole[:middle])
    query = log.decisions(log.tailed(spark, f"file://{tmp_path}/logs"), cards, 5000, None, None).writeStream.format("memory").queryName("live_sink").start()
    try:
        query.processAllAvailable()
        assert shown(spark.table("live_sink").collect()) == want[:1]
        path.write_bytes(whole)
        query.processAllAvailable()
        assert shown(spark.table("live_sink").collect()) == want
    finally:
        query.stop()


class Stored(dict):
    """A map state that counts what is asked of it."""

    def __init__(self, *a):
        super().__init__(*a)
        self.asked = 0

    def containsKey(self, k):
        self.asked += 1
        return k in self

    def getValue(self, k):
        self.asked += 1
        return self[k]

    def updateValue(self, k, v):
        self.asked += 1
        self[k] = v


def test_a_million_cards_are_touched_by_key():
    stored = Stored({(i,): (i, f"n{i}") for i in range(1_000_000)})
    cards = log.CardMap(stored)
    message = {"kind": "state", "cards": [{"instance": 5, "id": 77, "name": "new"}, {"instance": 6, "id": 6, "name": "n6"}], "local_seat": 1, "hand": [5, 999_999], "active_player": 1, "pending": True, "mulligans": 0, "opp_mulligans": 0}
    out = log.advance({}, cards, message)
    cards.flush()
    assert out[0]["hand_names"] == ["new", "n999999"] and stored[5,] == (77, "new") and len(stored) == 1_000_000
    assert stored.asked <= 6
    log.advance({}, cards, {"kind": "end"})
    assert cards.get(7) is None
    cards.flush()
    assert not stored


def test_a_reservoir_is_the_same_for_any_cut(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("r"), "id").alias("text"))
    drawn = []
    for k, files in enumerate((1, 5)):
        folder = f"file://{tmp_path}/in{k}"
        rows.orderBy(F.rand(k)).repartition(files).write.parquet(folder)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = reservoir.candidates(stream, 40, ["id"], shards=4).writeStream.format("memory").queryName(f"drawn{k}").trigger(availableNow=True).start()
        query.awaitTermination()
        passed = spark.table(f"drawn{k}")
        assert passed.count() < 1500
        drawn.append(sorted(map(tuple, reservoir.sample(passed, 40, ["id"]).collect())))
    want = rows.withColumn("p", F.xxhash64(F.lit(17), F.col("id").cast("string"))).orderBy("p", "id").limit(40).drop("p")
    assert drawn[0] == drawn[1] == sorted(map(tuple, want.collect())) and len(drawn[0]) == 40
