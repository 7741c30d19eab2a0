"""A live event log as a stream: framing, typed events, keyed state, decisions.

Blocks of a log follow a marker: a header, with the time or without, and JSON
on the same line or after it.  They come from growing files (``tail``) or from
a finished table.  Order holds within a source only: by the number of its
part, the block's place in it, and the place in the block.  Times are texts
that are passed on.

Card ids meet the catalogue in a stream-static join before the keyed state:
each card that a message shows is a row, so the join is a plain one, and what
leaves the state has its names whatever the sink.  The state is typed: a value
for each source, and a map from a card's instance to what it is, which is read
and written by key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.text import listed_in
from ..operators.ranks import clustered
from ..sources.materialise import held, scratch
from .tail import MARKER as MARKER_BYTES, tail

# Fixed values of the log's format.
MARKER = MARKER_BYTES.decode()
MOST_BLOCK = 2_000_000
TIME = r"^\s*(\d[^\n{=<]*)"
ORDER = ["part", "block", "place", "message", "line"]

#: A row of a message: of kind ``state``, ``deck``, ``end`` or ``failure`` (line -1), after the cards that it shows (line 0 on).
EVENT = "source string, part long, block long, place int, message int, line int, instance int, id int, copies int, kind string, at string, hand array<int>, local_seat int, mulligans int, opp_mulligans int, pending boolean, active_player int"
OUT = "source string, seq long, at string, what string, seat_id int, mulligan_count int, on_the_play boolean, opp_mulligan_count int, hand array<int>, deck array<int>, hand_names array<string>, deck_names array<string>, hand_unknown int, deck_unknown int"
FOUND = pa.schema([("source", pa.string()), ("seq", pa.int64()), ("at", pa.string()), ("what", pa.string()), ("seat_id", pa.int32()), ("mulligan_count", pa.int32()), ("on_the_play", pa.bool_()), ("opp_mulligan_count", pa.int32()), ("hand", pa.list_(pa.int32())), ("deck", pa.list_(pa.int32())), ("hand_names", pa.list_(pa.string())), ("deck_names", pa.list_(pa.string())), ("hand_unknown", pa.int32()), ("deck_unknown", pa.int32())])
#: The most rows of the catalogue that are broadcast.
MOST_NAMED = 200_000
#: Hours after which the cards of a match that never ended are forgotten, and days after which a source that fell silent is.
CARDS_HOURS, SOURCE_DAYS = 24, 60


def json_objects(text: str) -> list[str]:
    """Every top-level JSON object of a block; braces that begin none are passed over."""
    found, decoder, at = [], json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
            found.append(text[at:end])
        except ValueError:
            end = at + 1
        at = text.find("{", end)
    return found


def blocks(files: DataFrame, marker: str = MARKER) -> DataFrame:
    """(source, part, block, at, text) from whole texts (source, part, value): what stands before the first marker is junk; ``at`` is null without a time."""
    cut = files.select("source", "part", F.posexplode(F.split("value", "\\Q" + marker + "\\E", -1)).alias("block", "text")).filter("block > 0")
    return timed(cut.withColumn("block", F.col("block").cast("long")))


def timed(framed: DataFrame) -> DataFrame:
    return framed.withColumn("at", F.nullif(F.trim(F.regexp_extract("text", TIME, 1)), F.lit("")))


MESSAGES = """struct<greToClientEvent:struct<greToClientMessages:array<struct<type:string,systemSeatIds:array<int>,gameStateMessage:struct<gameObjects:array<struct<instanceId:int,grpId:int>>,
zones:array<struct<type:string,ownerSeatId:int,objectInstanceIds:array<int>>>,players:array<struct<systemSeatNumber:int,mulliganCount:int,pendingMessageType:string>>,turnInfo:struct<activePlayer:int>>>>>,
matchGameRoomStateChangedEvent:struct<gameRoomInfo:struct<stateType:string>>>"""


#: What a message says besides its cards; only its own row has it.
OWN = "kind string, at string, hand array<int>, local_seat int, mulligans int, opp_mulligans int, pending boolean, active_player int"
CARDS = "array<struct<instance:int,id:int,copies:int>>"
HEAD = ["source", "part", "block", "place"]


def _parsed() -> Callable[[Column], Column]:
    """Column function: the objects of a block as texts, each with its card lists, in which copies in a row are one entry; a text goes to Python once for both."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("decks", pa.list_(pa.list_(pa.struct([("id", pa.int64()), ("copies", pa.int32())]))))]))
    lists = listed_in("MainDeck")
    runs = lambda ids: [{"id": i, "copies": sum(1 for _ in same)} for i, same in groupby(ids)]

    def parse(texts: pa.Array) -> pa.Array:
        found = [json_objects(t or "") for t in texts.to_pylist()]
        return pa.array([[{"text": o, "decks": [runs(ids) for ids in lists(o)] if "MainDeck" in o else []} for o in objects] for objects in found], kind)

    return F.arrow_udf(parse, "array<struct<text:string,decks:array<array<struct<id:bigint,copies:int>>>>>")


def typed_messages(framed: DataFrame, most: int = MOST_BLOCK) -> DataFrame:
    """A row a message (source, part, block, place, message, own: ``OWN``, cards: ``CARDS``): game states, deck submissions and match ends, and a failure for each block of over ``most`` characters; other shapes give none."""
    large = F.length("text") > most
    objects = F.when(large, F.array(F.lit(None).cast("struct<text:string,decks:array<array<struct<id:bigint,copies:int>>>>"))).otherwise(_parsed()(F.when(~large, F.col("text"))))
    rows = framed.select("source", "part", "block", "at", large.alias("large"), F.posexplode(objects).alias("place", "o")).select(*HEAD, "at", "large", "o.decks", F.from_json("o.text", MESSAGES).alias("m"))
    kinds = dict(c.split() for c in OWN.split(", "))

    def message(kind: str, cards: Column, **own: Column) -> Column:
        own |= {"kind": F.lit(kind), "at": F.col("at")}
        return F.struct(F.struct(*[own.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]).alias("own"), cards.cast(CARDS).alias("cards"))

    def state(g: Column) -> Column:
        s, seat = g.gameStateMessage, F.get(g.systemSeatIds, F.lit(0))
        zone = F.get(F.filter(s.zones, lambda z: (z.type == "ZoneType_Hand") & (z.ownerSeatId == seat)), F.lit(0))
        mine = F.get(F.filter(s.players, lambda p: p.systemSeatNumber == seat), F.lit(0))
        theirs = F.get(F.filter(s.players, lambda p: p.systemSeatNumber != seat), F.lit(0))
        shown = F.transform(s.gameObjects, lambda o: F.struct(o.instanceId.alias("instance"), o.grpId.alias("id"), F.lit(1).alias("copies")))
        pending = F.coalesce(mine.pendingMessageType == "ClientMessageType_MulliganResp", F.lit(False))
        return message("state", shown, hand=zone.objectInstanceIds, local_seat=seat, mulligans=F.coalesce(mine.mulliganCount, F.lit(0)), opp_mulligans=theirs.mulliganCount, pending=pending, active_player=s.turnInfo.activePlayer)

    none = F.array().cast(CARDS)
    states = F.transform(F.filter("m.greToClientEvent.greToClientMessages", lambda g: g.gameStateMessage.isNotNull()), state)
    decks = F.transform("decks", lambda d: message("deck", F.transform(d, lambda c: F.struct(F.lit(None).cast("int").alias("instance"), c.id.cast("int").alias("id"), c.copies.alias("copies")))))
    ended = F.col("m.matchGameRoomStateChangedEvent.gameRoomInfo.stateType") == "MatchGameRoomStateType_MatchCompleted"
    found = [states, decks, F.when(ended, F.array(message("end", none))), F.when(F.col("large"), F.array(message("failure", none)))]
    # States before decks, should an object have both; numbered on, so that their cards don't mix.
    return rows.select(*HEAD, F.posexplode(F.concat(*[F.coalesce(x, F.array().cast(f"array<struct<own:struct<{OWN.replace(' ', ':').replace(',:', ',')}>,cards:{CARDS}>>")) for x in found])).alias("message", "x")).select(*HEAD, "message", "x.*")


def card_rows(messages: DataFrame) -> DataFrame:
    """Rows of ``EVENT``: each message after the cards that it shows; what isn't a card's is on the message's own row only."""
    cards = F.transform(F.coalesce("cards", F.array().cast(CARDS)), lambda c, i: F.struct(i.alias("line"), c.instance.alias("instance"), c.id.alias("id"), c.copies.alias("copies"), F.lit(None).cast(messages.schema["own"].dataType).alias("own")))
    itself = F.struct(F.lit(-1).alias("line"), *[F.lit(None).cast("int").alias(k) for k in ("instance", "id", "copies")], F.col("own"))
    return messages.select(*HEAD, "message", F.explode(F.concat(cards, F.array(itself))).alias("x")).select(*HEAD, "message", "x.line", "x.instance", "x.id", "x.copies", "x.own.*")


def typed_events(framed: DataFrame, most: int = MOST_BLOCK) -> DataFrame:
    """Rows of ``EVENT`` from blocks; see ``typed_messages``."""
    return card_rows(typed_messages(framed, most))


def with_names(events: DataFrame, cards: DataFrame) -> DataFrame:
    """``events`` with the ``name`` of each card's id (``cards``: id, name, an id once); null for an id that has none."""
    return events.join(cards.select("id", "name"), "id", "left")


def advance(state: dict, cards, event: dict) -> list[dict]:
    """One message of a source applied to its state; what it emits.

    ``cards``: from an instance to (id, name).  A decision comes out when the
    local player has a pending request and every card of the hand is known,
    unless it repeats the last one.  A deck comes out unless it has the same
    cards as the last one.  A match's end empties all but the deck.
    """
    if event["kind"] == "failure":
        return [{"what": "oversized_block"}]
    if event["kind"] == "deck":
        deck = [(c["id"], c["name"]) for c in event["cards"]]
        same = sorted(i for i, _ in deck) == sorted(i for i, _ in state.get("deck", []))
        state["deck"] = deck
        return [] if same else [_named({"what": "deck_submitted", "deck": deck})]
    if event["kind"] == "end":
        deck = state.get("deck")
        state.clear()
        cards.clear()
        if deck:
            state["deck"] = deck
        return [{"what": "match_ended"}]
    for c in event["cards"]:
        if c["instance"] is not None and c["id"] is not None:
            cards[c["instance"]] = (c["id"], c["name"])
    for key in ("local_seat", "hand"):
        if event[key] is not None:
            state[key] = event[key]
    if event["active_player"] is not None and "first" not in state:
        state["first"] = event["active_player"]
    hand = state.get("hand") or []
    if not event["pending"] or not hand or any(cards.get(i) is None for i in hand):
        return []
    on_the_play = None if "first" not in state else state["first"] == state.get("local_seat")
    shown = [cards.get(i) for i in hand]
    mark = json.dumps([state.get("local_seat"), event["mulligans"], sorted(i for i, _ in shown)])
    if mark == state.get("mark"):
        return []
    state["mark"] = mark
    what = "decision" if state.get("deck") else "no_deck"
    return [_named({"what": what, "seat_id": state.get("local_seat"), "mulligan_count": event["mulligans"], "on_the_play": on_the_play, "opp_mulligan_count": event["opp_mulligans"] if on_the_play is False else None, "hand": shown, "deck": state.get("deck")})]


def _named(row: dict) -> dict:
    """Ids and names of hand and deck apart; ``what`` becomes hand_unresolved or deck_unresolved where a decision has unknown ids."""
    out = dict(row)
    for part in ("hand", "deck"):
        found = row.get(part)
        if found is not None:
            out |= {part: [i for i, _ in found], f"{part}_names": [n for _, n in found if n is not None], f"{part}_unknown": sum(n is None for _, n in found)}
    if row["what"] == "decision":
        out["what"] = next((f"{part}_unresolved" for part in ("hand", "deck") if out[f"{part}_unknown"]), "decision")
    return out


class CardMap:
    """Cards by instance over a map state: what a batch asks for is read once, what it changed is written once, nothing else is touched."""

    def __init__(self, stored):
        self.stored, self.held, self.changed, self.emptied = stored, {}, set(), False

    def get(self, instance: int):
        if instance not in self.held:
            found = None if self.emptied or not self.stored.containsKey((instance,)) else self.stored.getValue((instance,))
            self.held[instance] = found and (found[0], found[1])
        return self.held[instance]

    def __setitem__(self, instance: int, card: tuple) -> None:
        if self.held.get(instance) != card:
            self.held[instance] = card
            self.changed.add(instance)

    def clear(self) -> None:
        self.held, self.changed, self.emptied = {}, set(), True

    def flush(self) -> None:
        if self.emptied:
            self.stored.clear()
        for instance in self.changed:
            self.stored.updateValue((instance,), self.held[instance])


def _plain(value):
    """Arrow's values as Python's: None for what is missing, lists, whole numbers, dictionaries."""
    if value is None or isinstance(value, float) and value != value or value is pd.NA:
        return None
    if isinstance(value, (str, bool)):
        return value
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if hasattr(value, "__len__"):
        return [_plain(x) for x in value]
    return bool(value) if type(value).__name__ == "bool_" else int(value)


def _columns(frame: pd.DataFrame) -> dict[str, list]:
    """A frame's columns as lists of Python's values: whole numbers beside missing ones come as floats."""
    whole = lambda values: [None if x != x else int(x) for x in values]
    return {c: whole(frame[c].tolist()) if frame[c].dtype.kind == "f" else frame[c].tolist() if frame[c].dtype.kind in "iub" else [_plain(x) for x in frame[c].tolist()] for c in frame.columns}


#: A message's own row comes after its cards.
OWN_LINE = 1 << 30
CARD = ["instance", "id", "name", "copies"]
SAID = ["source", *(c.split()[0] for c in OWN.split(", "))]


def _messages(rows: dict[str, list]) -> Iterator[dict]:
    """The rows of each message put together: its own row with its cards in order."""
    line, shown, said = rows["line"], [rows[c] for c in CARD], [(c, rows[c]) for c in SAID]
    order = list(zip(*(rows[c] for c in ORDER[:-1]), (OWN_LINE if n < 0 else n for n in line)))
    cards: list[dict] = []
    for k in sorted(range(len(line)), key=order.__getitem__):
        if line[k] >= 0:
            cards += _copies(*(values[k] for values in shown))
        else:
            yield {c: values[k] for c, values in said} | {"cards": cards}
            cards = []


def _copies(instance: int | None, number: int | None, name: str | None, copies: int) -> list[dict]:
    return [{"instance": instance, "id": number, "name": name}] * copies


def _listed(out: list[dict]) -> dict[str, list]:
    empty = {"hand_names": [], "deck_names": [], "hand_unknown": 0, "deck_unknown": 0}
    return {n: [row.get(n, empty.get(n)) for row in out] for n in (c.split()[0] for c in OUT.split(", "))}


GAME = "made long, local_seat int, first int, hand array<int>, mark string, deck_ids array<int>, deck_names array<string>"


class Decisions(StatefulProcessor):
    """A source's state: one value (``GAME``) and its cards by instance, each with a time to live (None: for ever)."""

    def __init__(self, cards_hours: float | None = None, source_days: float | None = None):
        self.cards_ms, self.source_ms = cards_hours and int(cards_hours * 3_600_000), source_days and int(source_days * 86_400_000)

    def init(self, handle) -> None:
        self.game = handle.getValueState("game", GAME, self.source_ms)
        self.cards = handle.getMapState("cards", "instance int", "id int, name string", self.cards_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        made, state = _opened(self.game.get() if self.game.exists() else None)
        cards, out = CardMap(self.cards), []
        for event in _messages(_columns(pd.concat(list(rows), ignore_index=True))):
            for row in advance(state, cards, event):
                made += 1
                out.append({"source": key[0], "seq": made, "at": event["at"], **row})
        cards.flush()
        deck = state.get("deck")
        self.game.update((made, state.get("local_seat"), state.get("first"), state.get("hand"), state.get("mark"), deck and [i for i, _ in deck], deck and [n for _, n in deck]))
        yield pd.DataFrame(_listed(out), dtype=object)

    def close(self) -> None:
        pass


def _opened(held: tuple | None) -> tuple[int, dict]:
    if held is None:
        return 0, {}
    made, seat, first, hand, mark, ids, names = held
    state = {"local_seat": seat, "first": first, "hand": None if hand is None else list(hand), "mark": mark, "deck": None if ids is None else list(zip(ids, names))}
    return made, {k: v for k, v in state.items() if v is not None}


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same over rows sorted by source and order: of a source, only its state, and the message at the end of a batch, is held."""
    source, made, state, cards, shown = None, 0, {}, {}, []
    for batch in batches:
        out = []
        for *card, own in zip(*(column.to_pylist() for column in batch.columns)):
            if own is None:
                shown += _copies(*card)
                continue
            event, shown = own | {"cards": shown}, []
            if event["source"] != source:
                source, made, state, cards = event["source"], 0, {}, {}
            for row in advance(state, cards, event):
                made += 1
                out.append({"source": source, "seq": made, "at": event["at"], **row})
        yield pa.RecordBatch.from_pydict(_listed(out), FOUND)


def decisions(framed: DataFrame, cards: DataFrame, most_block: int = MOST_BLOCK, cards_hours: float | None = CARDS_HOURS, source_days: float | None = SOURCE_DAYS) -> DataFrame:
    """Rows of ``OUT`` from a stream of blocks (source, part, block, at, text), names resolved; any sink takes them.

    With a time to live the query looks for what is over it at every trigger,
    so it never falls idle; without (None for both) it does.
    """
    spark = framed.sparkSession
    # Typed state lives in this store; the setting is read when the query starts.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = with_names(typed_events(framed, most_block), cards)
    return events.groupBy("source").transformWithStateInPandas(Decisions(cards_hours, source_days), OUT, "append", "processingTime" if cards_hours or source_days else "none")


def decisions_in_batch(events: DataFrame) -> DataFrame:
    """What ``decisions`` gives, of a finished table of named events: each source's go through a task in order, one batch after the other."""
    order = [*ORDER[:-1], F.col("line") < 0, "line"]
    rows = clustered(events, "source").sortWithinPartitions("source", *order)
    # What isn't a card's goes to Python in one value, which is null for a card.
    return rows.select(*CARD, F.when(F.col("line") < 0, F.struct(*SAID)).alias("own")).mapInArrow(_in_order, OUT)


def tailed(spark, path: str, **options) -> DataFrame:
    """Blocks of growing log files, ready for ``decisions``; see ``tail.LogTail`` for the options."""
    return timed(tail(spark, path, **options).withColumn("part", F.lit(0).cast("long")))


def _parts(logs: DataFrame) -> DataFrame:
    return logs if "part" in logs.columns else logs.withColumn("part", F.lit(0).cast("long"))


def _clustered_parts(logs: DataFrame) -> DataFrame:
    return clustered(_parts(logs), "source").sortWithinPartitions("source", "part").select("source", "value")


def land(logs: DataFrame, path: str) -> None:
    """A log file ``<source>.log`` for each source of (source, part, value), its parts in order; sources that share a task are written one after the other.  Logs that are clustered by source already aren't shuffled again."""
    names = logs.schema["source"].name

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        source, out = None, None
        for batch in batches:
            for name, value in zip(batch[names], batch["value"]):
                if name != source:
                    if out is not None:
                        out.close()
                    source, out = name, system.open_output_stream(f"{root}/{name}.log")
                out.write(value.encode("utf-8"))
        if out is not None:
            out.close()
        yield pd.DataFrame({"done": [True]})

    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    system.create_dir(root, recursive=True)
    _clustered_parts(logs).mapInPandas(write, "done boolean").write.format("noop").mode("overwrite").save()


def live(logs: DataFrame, cards: DataFrame, folder: str | None = None, most_block: int = MOST_BLOCK, most_bytes: int = 64 << 20) -> DataFrame:
    """All logs through the stream until nothing is left: landed as files, tailed in batches of at most ``most_bytes`` a file, decided, written.

    ``logs``: (source, value) and, where a source has several parts, part.
    """
    spark = logs.sparkSession
    root = f"{folder}/live-{uuid.uuid4().hex}" if folder else scratch(spark, "live")
    land(logs, f"{root}/logs")
    stream = decisions(tailed(spark, f"{root}/logs", closed="true", maxbytes=str(most_bytes)), cards, most_block, None, None)
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(OUT).parquet(f"{root}/out")


def replay(logs: DataFrame, cards: DataFrame, most_block: int = MOST_BLOCK) -> DataFrame:
    """The same logic over logs that are all there, without a stream.

    The messages are written once: the ids that they name are counted before
    the catalogue's rows of these are joined, since few ids have all rows and
    the catalogue may be large.
    """
    messages = held(typed_messages(blocks(_parts(logs)), most_block), "messages")
    ids = messages.select(F.explode("cards.id").alias("id")).distinct()
    named = held(cards.select("id", "name").join(ids, "id", "left_semi"), "named")
    small = named.count() <= MOST_NAMED
    # Messages are shuffled, not each card; the same shuffle serves the decisions.
    return decisions_in_batch(with_names(card_rows(clustered(messages, "source")), F.broadcast(named) if small else named))


def logs_of_events(events: DataFrame) -> DataFrame:
    """Logs that a client would write: a user's events become decks, game states, requests and ends of matches, and a malformed object for each error."""
    # Short rows are shuffled, texts are written after that.
    events = clustered(events.select(F.col("user_id").cast("string").alias("source"), "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("n")), "source")
    c = F.col
    n = c("n")
    ids = F.sequence(F.lit(1), F.lit(7))
    deck = F.to_json(F.struct(F.struct(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(((n + i) % 190).alias("cardId"), (i + 1).alias("quantity"))).alias("MainDeck")).alias("deck")))
    objects = F.transform(ids, lambda i: F.struct(i.alias("instanceId"), ((n * 3 + i) % 210).cast("int").alias("grpId")))
    players = F.array(F.struct(F.lit(1).alias("systemSeatNumber"), (n % 3).alias("mulliganCount"), F.when(c("event_type") == "view", "ClientMessageType_MulliganResp").otherwise("none").alias("pendingMessageType")), F.struct(F.lit(2).alias("systemSeatNumber"), (n % 2).alias("mulliganCount"), F.lit("none").alias("pendingMessageType")))
    state = F.struct(objects.alias("gameObjects"), F.array(F.struct(F.lit("ZoneType_Hand").alias("type"), F.lit(1).alias("ownerSeatId"), ids.alias("objectInstanceIds"))).alias("zones"), players.alias("players"), F.struct((n % 2 + 1).alias("activePlayer")).alias("turnInfo"))
    game = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("GREMessageType_GameStateMessage").alias("type"), F.array(F.lit(1)).alias("systemSeatIds"), state.alias("gameStateMessage"))).alias("greToClientMessages")).alias("greToClientEvent")))
    end = F.lit('{"matchGameRoomStateChangedEvent": {"gameRoomInfo": {"stateType": "MatchGameRoomStateType_MatchCompleted"}}}')
    body = F.when(c("event_type") == "purchase", deck).when(c("event_type").isin("click", "view"), game).when(c("event_type") == "error", F.lit('{"broken": ')).otherwise(end)
    block = F.concat(F.lit(MARKER), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("\n"), body, F.lit("\n"))
    # A user's log comes in parts of a day's blocks.
    return events.withColumn("b", block).groupBy("source", F.date_trunc("day", "ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "b"))).alias("x")).select(F.concat(F.lit("junk\n"), F.array_join("x.b", "")).alias("value"), "source", F.unix_timestamp("day").alias("part"))
