"""Operator 13: repair of damaged conversations, by the auction algorithm for shortest paths.

A conversation's rows are layers of a lattice; in each layer there is a node for each state of the roles so far (nothing
yet, a system row, a user row, an assistant row). Arcs are edits of integer cost. Every node has a price, at first 0. A path starts
at an origin; at its last node the cheapest arc, its cost and the price behind it together, decides: if that
is dearer than the node's price, the price rises to it and the path contracts by a node, otherwise it is extended along the arc.
When it reaches the end, prices on it are exact distances. Arcs whose cost is the difference of the prices at
their ends are tight; every cheapest sequence of edits consists of tight arcs, so the least one by its letters is traced by taking
at each node the least letter whose arc is tight, once the auction has settled the price behind it.

A conversation of any length is cut into chunks of rows. The distances through a chunk, from each state to each, are the arcs
of a coarse lattice over chunks; its prices are what each chunk's own trace ends on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import salted_join, slices, written
from tessera.operators.ordered import numbered

#: Rows of a chunk, at most.
CHUNK = 4096
#: Layers between those that are settled first, so that no path contracts farther than that.
STRIDE = 4
#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
INFINITE = 1 << 60
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"

# States: nothing yet, system, user, assistant. Initials of roles have the same numbers, others are 0.
STATES = 4
#: (state, initial) -> state, where a row may be kept.
KEPT = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}
#: The state behind a user or assistant row that is made in a state: only one of them fits.
MADE = (2, 2, 3, 2)
#: What ending in each state costs, and by which edits.
END_COSTS, END_LETTERS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
#: Faults: none, blank, duplicate, truncated. A row's code is a letter: A + initial + 4 * fault.
SOUND, BLANK, DUPLICATE, SHORT = range(4)


class Lattice:
    """Prices of a layered graph. `arcs(layer, state)` lists (letter, cost, layer, state) in the order of letters;
    `ends` are the prices of the last layer's nodes."""

    def __init__(self, layers: int, arcs: Callable[[int, int], list[tuple[str, int, int, int]]], ends: list[int]):
        self.layers = layers
        self.of = [[(letter, cost, STATES * i + q) for letter, cost, i, q in arcs(layer, state)] for layer in range(layers) for state in range(STATES)]
        self.price = [0] * (STATES * layers) + list(ends)
        self.settled = [False] * (STATES * layers) + [True] * STATES
        # From the end on, a few layers at a time start at the least price behind them, which keeps every price at most its arc's
        # cost and the next price together: no price has to climb far.
        for last in range(layers, 0, -STRIDE):
            begin = max(last - STRIDE, 0)
            least = min(self.price[STATES * last : STATES * (last + 1)])
            self.price[STATES * begin : STATES * last] = [least] * (STATES * (last - begin))
            for state in range(STATES):
                self.settle(STATES * begin + state)

    def settle(self, origin: int) -> int:
        """The auction from one origin; prices stay for later ones. A settled node ends the path as the goal does."""
        price, settled, path = self.price, self.settled, [origin]
        while not settled[path[-1]]:
            node = path[-1]
            least, to = min(((cost + price[to], to) for _, cost, to in self.of[node]), default=(INFINITE, node))
            if least >= INFINITE:  # the end can't be reached from here
                price[node], settled[node] = INFINITE, True
                path.pop()
                if not path:
                    return INFINITE
            elif price[node] < least:
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            settled[node] = True
        return price[origin]

    def trace(self, state: int) -> tuple[str, int] | None:
        """The least letters of a cheapest way from a state of the first layer, and the state it ends in; none without a way."""
        node, letters = state, []
        if self.settle(node) >= INFINITE:
            return None
        while node < STATES * self.layers:
            for letter, cost, to in self.of[node]:
                if self.price[node] == cost + self.settle(to):
                    letters.append(letter)
                    node = to
                    break
        return "".join(letters), node - STATES * self.layers


def edits(codes: str, most: int = STATES - 1) -> Callable[[int, int], list[tuple[str, int, int, int]]]:
    """The arcs of a conversation's rows, through states up to `most` only."""
    rows = [divmod(ord(c) - ord("A"), 4) for c in codes]

    def arcs(layer: int, state: int) -> list[tuple[str, int, int, int]]:
        fault, initial = rows[layer]
        out, more = [("D", DELETE, layer + 1, state), ("I", INSERT, layer, MADE[state])], TRUNCATED if fault == SHORT else 0
        if fault not in (BLANK, DUPLICATE):
            if (state, initial) in KEPT:
                out.append(("K", more, layer + 1, KEPT[state, initial]))
            out.append(("R", REROLE + more, layer + 1, MADE[state]))
        return [a for a in out if state <= most and a[3] <= most]

    return arcs


def distances(codes: str) -> list[int]:
    """The cheapest costs through a chunk from each state (row) to each (column), one after the other; insertions
    behind its last row belong to what follows."""
    out = [INFINITE] * (STATES * STATES)
    for end in range(STATES):
        # Only states up to `end` lead to the first two, which are never entered again.
        found = Lattice(len(codes), edits(codes, end if end < 2 else STATES - 1), [0 if q == end else INFINITE for q in range(STATES)])
        for state in range(STATES):
            out[STATES * state + end] = found.settle(state) if end >= 2 or state <= end else INFINITE
    return out


def boundary_prices(matrices: list[list[int]]) -> list[list[int]]:
    """From the chunks' distances the prices of all nodes between chunks, and behind the last one."""
    def arcs(layer: int, state: int) -> list[tuple[str, int, int, int]]:
        row = matrices[layer][STATES * state : STATES * (state + 1)]
        return [("", cost, layer + 1, q) for q, cost in enumerate(row) if cost < INFINITE]

    coarse = Lattice(len(matrices), arcs, list(END_COSTS))
    return [[coarse.settle(STATES * i + q) for q in range(STATES)] for i in range(len(matrices) + 1)]


def repaired(codes: str) -> tuple[int, str]:
    """The cost and the letters of a conversation's cheapest edits."""
    lattice = Lattice(len(codes), edits(codes), list(END_COSTS))
    letters, end = lattice.trace(0)
    return lattice.price[0], letters + END_LETTERS[end]


LEGAL = {(1, 2), (2, 3), (3, 2)}


def tallies(codes: str) -> list[int]:
    """Blank, duplicate and truncated rows, and illegal neighbours."""
    rows = [divmod(ord(c) - ord("A"), 4) for c in codes]
    return [*(sum(f == fault for f, _ in rows) for fault in (BLANK, DUPLICATE, SHORT)), sum((a[1], b[1]) not in LEGAL for a, b in zip(rows, rows[1:], strict=False))]


def or_blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(df: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after damage by crc32(`conv_id:turn`) modulo 20; nulls are one space there and
    in role and text."""
    kind = F.crc32(F.concat(or_blank("conv_id"), F.lit(":"), or_blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(or_blank("text"), STOPS, "")).otherwise(or_blank("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(or_blank("role"))
    copies = F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


#: What tells conversations apart, null among them.
KEYS = ["no_conv", "conv"]


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"no_conv": F.col("conv_id").isNull(), "conv": F.coalesce("conv_id", F.lit(0)).cast("long"), "has_turn": F.col("turn").isNotNull()})


def coded(rows: DataFrame) -> DataFrame:
    """(keys, position, code, last) for rows with keys: position counts all rows in the order of conversations, turns (null first),
    roles and texts; no text goes along."""
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in (("s", 1), ("u", 2), ("a", 3)) for x in pair]), F.substring("role", 1, 1)), F.lit(0))
    fault = F.when(F.length(F.translate("text", BLANKS, "")) == 0, F.lit(BLANK)).when(~F.substring(bare, -1, 1).isin(*STOPS), F.lit(SHORT)).otherwise(F.lit(SOUND))
    facts = rows.select(*KEYS, "has_turn", "turn", "role", "text", initial.alias("initial"), fault.alias("fault"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"))
    # What is sorted is written without the texts.
    placed = numbered(facts, [*KEYS, "has_turn", "turn", "role", "text"], [*KEYS, "initial", "fault", "h1", "h2"])
    same = placed.groupBy(*KEYS, "h1", "h2").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    found = salted_join(placed, same, [*KEYS, "h1", "h2"], "n")
    fault = F.when((F.col("fault") != BLANK) & (F.col("position") > F.col("first")), F.lit(DUPLICATE)).otherwise(F.col("fault"))
    return found.select(*KEYS, "position", F.char(F.lit(ord("A")) + F.col("initial") + 4 * fault).alias("code"))


def chunks(codes: DataFrame) -> DataFrame:
    """(keys, block, codes): at most CHUNK consecutive rows of a conversation as one text of codes."""
    block = F.expr(f"position div {CHUNK}").alias("block")
    held = F.sort_array(F.collect_list(F.struct("position", "code")))
    return codes.groupBy(*KEYS, block).agg(F.array_join(F.transform(held, lambda x: x["code"]), "").alias("codes"))


def mapped(fn: Callable[[dict], dict], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            yield pa.RecordBatch.from_pylist([fn(r) for r in rows.to_pylist()], schema=schema)

    return run


LONGS, TEXTS = pa.list_(pa.int64()), pa.list_(pa.string())


def audits(parts: DataFrame) -> DataFrame:
    """(keys, tallies, cost, audit) of each conversation from its chunks, written. Conversations of one chunk are solved by a row each; of
    longer ones the chunks' distances meet, 16 numbers each, and each chunk is traced from every state it may be entered in."""
    key_ddl, key_fields = "no_conv boolean, conv long", [("no_conv", pa.bool_()), ("conv", pa.int64())]
    sizes = parts.groupBy(*KEYS).agg(F.count("*").alias("parts"))
    counted = written(parts.join(sizes, KEYS), "chunks")
    single, several = counted.where("parts = 1"), counted.where("parts > 1")

    def whole(r: dict) -> dict:
        cost, audit = repaired(r["codes"])
        return {"no_conv": r["no_conv"], "conv": r["conv"], "tallies": tallies(r["codes"]), "cost": cost, "audit": audit}

    out_ddl, out_schema = f"{key_ddl}, tallies array<long>, cost long, audit string", pa.schema([*key_fields, ("tallies", LONGS), ("cost", pa.int64()), ("audit", pa.string())])
    short = single.select(*KEYS, "codes").mapInArrow(mapped(whole, out_schema), out_ddl)

    def through(r: dict) -> dict:
        ends = [(ord(c) - ord("A")) % 4 for c in (r["codes"][0], r["codes"][-1])]
        return {"no_conv": r["no_conv"], "conv": r["conv"], "block": r["block"], "facts": [*distances(r["codes"]), *tallies(r["codes"]), *ends]}

    found = several.select(*KEYS, "block", "codes").mapInArrow(mapped(through, pa.schema([*key_fields, ("block", pa.int64()), ("facts", LONGS)])), f"{key_ddl}, block long, facts array<long>")
    lists = found.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("block", "facts"))).alias("parts"))

    def along(r: dict) -> dict:
        facts, size = [p["facts"] for p in r["parts"]], STATES * STATES
        prices = boundary_prices([f[:size] for f in facts])
        total = [sum(f[size + i] for f in facts) for i in range(4)]
        total[3] += sum((a[-1], b[-2]) not in LEGAL for a, b in zip(facts, facts[1:], strict=False))
        return {"no_conv": r["no_conv"], "conv": r["conv"], "blocks": [p["block"] for p in r["parts"]], "prices": [v for p in prices[1:] for v in p], "tallies": total, "cost": prices[0][0]}

    plan_schema = pa.schema([*key_fields, ("blocks", LONGS), ("prices", LONGS), ("tallies", LONGS), ("cost", pa.int64())])
    plans = written(lists.mapInArrow(mapped(along, plan_schema), f"{key_ddl}, blocks array<long>, prices array<long>, tallies array<long>, cost long"), "prices")
    ahead = plans.select(*KEYS, F.posexplode("blocks").alias("i", "block"), "prices").select(*KEYS, "block", F.slice("prices", STATES * F.col("i") + 1, STATES).alias("ends"))

    def traced(r: dict) -> dict:
        lattice = Lattice(len(r["codes"]), edits(r["codes"]), r["ends"])
        ways = [lattice.trace(q) or ("", -1) for q in range(STATES)]
        return {"no_conv": r["no_conv"], "conv": r["conv"], "block": r["block"], "letters": [w[0] for w in ways], "ends": [w[1] for w in ways]}

    ways = several.join(ahead, [*KEYS, "block"]).select(*KEYS, "block", "codes", "ends").mapInArrow(mapped(traced, pa.schema([*key_fields, ("block", pa.int64()), ("letters", TEXTS), ("ends", LONGS)])), f"{key_ddl}, block long, letters array<string>, ends array<long>")
    chains = ways.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("block", "letters", "ends"))).alias("parts"))

    def joined(r: dict) -> dict:
        state, letters = 0, []
        for p in r["parts"]:
            letters.append(p["letters"][state])
            state = p["ends"][state]
        return {"no_conv": r["no_conv"], "conv": r["conv"], "audit": "".join(letters) + END_LETTERS[state]}

    long = chains.mapInArrow(mapped(joined, pa.schema([*key_fields, ("audit", pa.string())])), f"{key_ddl}, audit string")
    return written(short.union(plans.join(long, KEYS).select(*KEYS, "tallies", "cost", "audit")), "audits")


def transcripts(rows: DataFrame, edits_of: DataFrame, digest: Callable[[], object] = hashlib.sha256) -> DataFrame:
    """(keys, repaired_sha256): each conversation's rows pass in order behind its audit, whose letters tell what becomes of each.

    A hash of a whole text can't be computed in pieces, so a conversation passes through one task, row by row; what is held is its audit
    and one row."""
    text = rows.select(*KEYS, F.lit(1).alias("kind"), "has_turn", "turn", "role", "text")
    ahead = edits_of.select(*KEYS, F.lit(0).alias("kind"), F.lit(False).alias("has_turn"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    dealt = text.unionByName(ahead).repartition(*KEYS).sortWithinPartitions(*KEYS, "kind", "has_turn", "turn", "role", "text")
    names = {1: "system", 2: "user", 3: "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, state, text_hash, first = None, "", 0, 0, None, True

        def line(role: str, said: str) -> None:
            nonlocal first
            text_hash.update((("" if first else "\n") + role + ":" + said).encode())
            first = False

        def inserted() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, at = MADE[state], at + 1
                line(names[state], "")

        def ended() -> list[tuple]:
            if key is None:
                return []
            inserted()
            return [(*key, text_hash.hexdigest())]

        for batch in batches:
            done = []
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                no_conv, conv, kind, role, said = *(c[i].as_py() for c in columns), batch.column(4)[i].as_py()
                if kind == 0:
                    done += ended()
                    key, audit, at, state, text_hash, first = (no_conv, conv), said, 0, 0, digest(), True
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = KEPT[state, {"s": 1, "u": 2, "a": 3}[role[0]]]
                    line(role, said)
                elif edit == "R":
                    state = MADE[state]
                    line(names[state], said)
            if done:
                yield out(done)
        if last := ended():
            yield out(last)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["no_conv", "conv", "repaired_sha256"])

    return dealt.select(*KEYS, "kind", "role", "text").mapInArrow(run, "no_conv boolean, conv long, repaired_sha256 string")


def repair(df: DataFrame) -> DataFrame:
    """A row for each conv_id of df (conv_id long, turn long, role, text; others are ignored), a null one too: gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    df's rows are damaged first (`damaged`). In equal turns rows go by role and text, and so do rows with a null turn, which come first;
    repeated rows are rows of their own, and later ones are duplicates. Null roles and texts are one space. Without rows after the damage
    all counts are 0 and the repaired text is empty. An empty table gives none. Rows of a conversation lie in many tasks; its
    audit, as the result wants it, in one row.
    """
    rows = keyed(damaged(df))
    done = audits(chunks(coded(rows)))
    turns = rows.groupBy(*KEYS).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    hashes = transcripts(rows, done)
    every = keyed(df.select("conv_id", F.lit(None).cast("long").alias("turn"))).select("conv_id", *KEYS).distinct()
    found = done.join(turns, KEYS).join(hashes, KEYS)
    counts = [F.coalesce(F.get("tallies", F.lit(i)), F.lit(0)).alias(n) for i, n in enumerate(("blank", "duplicate", "truncated", "illegal"))]
    return every.join(found, KEYS, "left").select(
        "conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), *counts, F.coalesce("cost", F.lit(0)).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
