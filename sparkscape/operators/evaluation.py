"""Evaluation of a message channel on the W its own texts induce.

Each series is a channel with a corpus of its own: messages enter it in order, W is first built
once there are enough texts of enough devices, later rebuilt by the policy (structural before volume
before time), and each message is measured on W plus what was accumulated in W's cycle. A panel
depends on all before it, so a series is folded in order by one ``Channel``, whose state is the
corpus as term counts, W and a few matrices of the nodes; series are spread by key. The same object
serves the batch fold and the stream, where its state lives between batches.

Weights are integers: with raw = W's counts and top their largest absolute, W + delta has the signs
of raw + top * delta, so no field is rounded.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscape.functions import text as T
from sparkscape.operators import wide
from sparkscape.operators.monitor import _fold_by

# The policy's thresholds.
MIN_TEXTS, MIN_DEVICES, EVERY, CYCLES, RISES = 30, 2, 10, 10, 3
PANEL = (
    "series string, rec_id bigint, t bigint, mode string, w_sha string, n_nodes int, version int, reset string, n_declared int, n_accepted int, n_expelled int, n_torn int, n_rejected int, "
    "fabrication double, c_s double, n_eff double, n_eff0 double, d_ckm double, delta_sum bigint, torn_sum bigint, period int, tail int, isolated int, isolated_eff int, corpus_size bigint, n_devices int, "
    "cause string, rebuilt boolean, no_rebuild string, sha_before string, sha_after string, cycles_since int, n_points int"
)
NAMES = [c.split()[0] for c in PANEL.split(", ")]
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
TYPES = [_ARROW[c.split()[1]] for c in PANEL.split(", ")]


class Corpus:
    """Term counts of texts, and the signed W of their best terms: the same nodes and weights as ``corpus.signed_w``."""

    def __init__(self, top_k: int):
        self.top_k = top_k
        self.terms: dict[str, int] = {}
        self.cells: list[np.ndarray] = []  # rows (text, term, n)
        self.signs: list[int] = []
        self.members: list[str] | None = None

    def add(self, words: list[str], opposes: bool) -> None:
        counts = Counter(words)
        own = np.array([(len(self.signs), self.terms.setdefault(w, len(self.terms)), n) for w, n in counts.items()], dtype=np.int64).reshape(-1, 3)
        self.cells.append(own)
        self.signs.append(-1 if opposes else 1)

    def build(self) -> tuple[list[str], np.ndarray]:
        """(nodes by score, then term; raw weights)."""
        self.cells = [np.concatenate(self.cells)]
        unit, term, n = self.cells[0].T
        size = len(self.terms)
        df, tf = np.bincount(term, minlength=size), np.bincount(term, weights=n, minlength=size)
        names = list(self.terms)
        pool = sorted((k for k in np.nonzero(df >= 2)[0]), key=lambda k: (-tf[k], names[k]))[: 3 * self.top_k]
        if not pool:
            return [], np.zeros((0, 0))
        units = len(self.signs)
        at = np.full(size, -1)
        at[pool] = np.arange(len(pool))
        kept = at[term] >= 0
        u, p = unit[kept], at[term[kept]]
        x = n[kept] * (np.log((1 + units) / (1 + df[pool]))[p] + 1)
        norm = np.sqrt(np.bincount(u, weights=x * x, minlength=units))
        score = np.round(np.bincount(p, weights=x / norm[u], minlength=len(pool)) / units, 9)
        order = sorted(range(len(pool)), key=lambda k: (-score[k], names[pool[k]]))
        chosen = order
        if len(order) > self.top_k:
            cut = score[order[self.top_k - 1]]
            above = [k for k in order if score[k] - cut > 1e-12]
            ties = [k for k in order if abs(score[k] - cut) <= 1e-12]
            if len(ties) > self.top_k - len(above):  # not all fit: those that were in stay
                ties = [k for k in ties if self.members is not None and names[pool[k]] in self.members]
            inside = set(above) | set(ties)
            chosen = [k for k in order if k in inside]
        nodes = [names[pool[k]] for k in chosen]
        place = np.full(len(pool), -1)
        place[chosen] = np.arange(len(chosen))
        own = place[p] >= 0
        present = np.zeros((units, len(nodes)))
        present[u[own], place[p[own]]] = 1
        raw = present.T @ (present * np.array(self.signs, float)[:, None])
        np.fill_diagonal(raw, 0)
        self.members = nodes
        return nodes, raw


def sha(raw: np.ndarray) -> str:
    return hashlib.sha256(repr(raw.astype(np.int64).tolist()).encode()).hexdigest()


def change(before: tuple[list[str], str] | None, after: tuple[list[str], str]) -> str | None:
    """How W changed: N (size), nodes (labels or their order), weights; None if it didn't, or is the first."""
    if before is None or before[1] == after[1]:
        return None
    return "N" if len(before[0]) != len(after[0]) else "nodes" if before[0] != after[0] else "weights"


class Channel:
    """The state of one series and what a message does to it."""

    def __init__(self, top_k: int = 12, runs: int = 100, seed: int = 0):
        self.corpus = Corpus(top_k)
        self.runs, self.seed = runs, seed
        self.devices: set[str] = set()
        self.w: tuple[list[str], np.ndarray, str] | None = None  # nodes, raw, sha
        self.used: tuple[list[str], str] | None = None  # nodes and sha the last panel was measured on
        self.delta = self.torn = np.zeros((0, 0))
        self.first: float | None = None
        self.version = self.count = self.texts_since = self.cycles = 0
        self.distances: list[float] = []

    # -- corpus and rebuilds

    def missing(self) -> str | None:
        """Why no W can be built."""
        return "few texts" if len(self.corpus.signs) < MIN_TEXTS else "few devices" if len(self.devices) < MIN_DEVICES else None

    def rebuild(self) -> tuple[bool, str | None]:
        why = self.missing() if self.w is None else None
        if why:
            return False, why
        nodes, raw = self.corpus.build()
        if not nodes:
            return False, "no nodes"
        new = sha(raw)
        if self.w is None or new != self.w[2]:
            self.version += 1
        self.w = (nodes, raw, new)
        return True, None

    def sha(self) -> str | None:
        return self.w[2] if self.w else None

    def rising(self) -> bool:
        d = self.distances[-RISES - 1 :]
        return len(d) == RISES + 1 and all(b > a for a, b in zip(d, d[1:]))

    def message(self, words: list[str], opposes: bool, device: str | None, system: bool) -> dict:
        """The panel and the decision of one message. A system message is measured, but doesn't enter the corpus."""
        before, out = self.sha(), {"cause": None, "rebuilt": False, "no_rebuild": None}
        if not system:
            if device is not None:
                self.devices.add(device)
            self.corpus.add(words, opposes)
        counters = (self.cycles, len(self.distances))
        if self.w is None and self.missing() is None:
            done, why = self.rebuild()
            out |= {"cause": "first", "rebuilt": done, "no_rebuild": why}
        self.count += 1
        self.texts_since += 1
        if self.sha() != before:
            self.cycles = self.texts_since = 0
            self.distances = []
        else:
            self.cycles += 1
        out |= self.panel(words) if self.count >= MIN_TEXTS and self.w else {"mode": "accumulation", "w_sha": self.sha()}
        out["version"] = self.version  # of the W the panel is on
        if out.get("d_ckm") is not None:
            self.distances.append(out["d_ckm"])
        if out["cause"] is None:
            cause = "structural" if self.rising() else "volume" if self.texts_since >= EVERY else "time" if self.cycles >= CYCLES else None
            if cause:
                before, counters = self.sha(), (self.cycles, len(self.distances))
                done, why = self.rebuild()
                out |= {"cause": cause, "rebuilt": done, "no_rebuild": why}
                if done:
                    self.cycles = self.texts_since = 0
                    self.distances = []
        if out["cause"]:
            out |= {"sha_before": before, "sha_after": self.sha(), "cycles_since": counters[0], "n_points": counters[1]}
        return out | {"corpus_size": len(self.corpus.signs), "n_devices": len(self.devices)}

    # -- measuring

    def samples(self, n: int) -> np.ndarray:
        """First states for the effective number, the same for every panel: 30 to 70 % of the nodes."""
        g = np.random.Generator(np.random.Philox(key=[self.seed, n]))
        act = np.maximum(1, np.rint((0.3 + 0.4 * g.random(self.runs)) * n)).astype(int)
        rank = g.random((self.runs, n)).argsort(axis=1).argsort(axis=1)
        return np.where(rank < act[:, None], 1.0, -1.0)

    def panel(self, words: list[str]) -> dict:
        nodes, raw, w_sha = self.w
        n, top = len(nodes), np.abs(raw).max() or 1.0
        reset = change(self.used, (nodes, w_sha))
        if self.used is None or self.used[1] != w_sha:  # what was accumulated belongs to another W
            self.delta, self.torn, self.first = np.zeros((n, n)), np.zeros((n, n)), None
        self.used = (nodes, w_sha)
        own = set(words)
        sigma = np.array([1.0 if x in own else -1.0 for x in nodes])
        a, b, period, tail, last = (x[0] for x in wide.relax(sigma[None, :], raw + top * self.delta))
        active = sigma > 0
        pair = np.triu(np.outer(active, active), 1)
        falls = [pair & ((f < 0)[:, None] | (f < 0)[None, :]) for f in (a, b)]
        expelled, torn = falls[0] & falls[1], falls[0] ^ falls[1]
        rejected = pair & ((last < 0)[:, None] | (last < 0)[None, :])
        self.delta = self.delta + expelled + expelled.T
        self.torn = self.torn + torn + torn.T
        effective = raw + top * self.delta
        masses = Counter(wide.orbit_names(self.samples(n), effective))
        n_eff = round(self.runs**2 / sum(c * c for c in masses.values()), 9)
        self.first = n_eff if self.first is None else self.first
        d = 1 - math.log(n_eff) / math.log(self.first) if self.first > 1 else None
        upper = np.triu_indices(n, 1)
        return {
            "mode": "evaluation", "w_sha": w_sha, "n_nodes": n, "reset": reset, "n_declared": int(pair.sum()), "n_expelled": int(expelled.sum()), "n_torn": int(torn.sum()),
            "n_accepted": int(pair.sum() - expelled.sum() - torn.sum()), "n_rejected": int(rejected.sum()),
            "fabrication": round(float((active & (last < 0)).sum() / active.sum()), 4) if active.any() else 0.0,
            "c_s": round(float((raw / top * np.outer(last, last))[upper].mean()), 6) if n > 1 else 0.0,
            "n_eff": round(n_eff, 4), "n_eff0": round(self.first, 4), "d_ckm": None if d is None else round(d, 4), "delta_sum": int(self.delta.sum()), "torn_sum": int(self.torn.sum()),
            "period": int(period), "tail": int(tail), "isolated": int((~raw.any(axis=1)).sum()), "isolated_eff": int((~effective.any(axis=1)).sum()),
        }


def messages(trajectory: DataFrame, system: Column | None = None) -> DataFrame:
    """series, t, rec_id, device_id, words, opposes, system of messages with a text that isn't blank.

    ``system`` marks messages of the system itself; by default those without a device. Rows without series or rec_id
    belong to no channel and are left out."""
    own = F.col("device_id").isNull() if system is None else system
    m = trajectory.where(F.coalesce(T.not_blank(F.col("text")), F.lit(False))).where("series is not null and rec_id is not null")
    return m.select("series", F.col("t").cast("bigint").alias("t"), "rec_id", "device_id", T.analyze(F.col("text")).alias("words"), T.opposes(F.col("text")).alias("opposes"), F.coalesce(own, F.lit(False)).alias("system"))


def row(series: str, rec_id: int, t: int | None, got: dict) -> tuple:
    whole = got | {"series": series, "rec_id": rec_id, "t": t}
    return tuple(whole.get(c) for c in NAMES)


def evaluated(trajectory: DataFrame, top_k: int = 12, runs: int = 100, seed: int = 0, system: Column | None = None) -> DataFrame:
    """PANEL rows, one a message, each series in the order of t, rec_id; a record delivered again comes once, in its last form."""
    last = trajectory.where("rec_id is not null").groupBy("rec_id").agg(F.max(F.struct("received_at", "series", "t", "device_id", "text")).alias("r")).select("rec_id", "r.*")
    ordered = messages(last, system).repartition("series").sortWithinPartitions("series", "t", "rec_id")

    def run(key, batches):
        channel = Channel(top_k, runs, seed)
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("rec_id", "t", "words", "opposes", "device_id", "system")]
            out = [row(key, i, t, channel.message(w, o, d, s)) for i, t, w, o, d, s in zip(*cols)]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out), TYPES)], names=NAMES)

    return _fold_by(ordered, "series", run, PANEL)


def dump(channel: Channel) -> bytes:
    return pickle.dumps(channel, protocol=5)


def load(state: bytes) -> Channel:
    return pickle.loads(state)


def version_register(panels: DataFrame) -> DataFrame:
    """series, version, w_sha, since (rec_id, t and corpus size of its first message), n_messages: the versions of each series' W."""
    g = panels.where("w_sha is not null").groupBy("series", "version", "w_sha")
    first = F.min(F.struct("t", "rec_id", "corpus_size"))
    return g.agg(first.alias("f"), F.count("*").alias("n_messages")).select("series", "version", "w_sha", F.col("f.t").alias("t"), F.col("f.rec_id").alias("rec_id"), F.col("f.corpus_size").alias("corpus_size"), "n_messages")


def decisions(panels: DataFrame) -> DataFrame:
    """The log of rebuild decisions: one row per decision, with the counters when it was taken."""
    return panels.where("cause is not null").select("series", "rec_id", "t", "cause", "rebuilt", "no_rebuild", "sha_before", "sha_after", (~F.col("sha_before").eqNullSafe(F.col("sha_after"))).alias("w_changed"), "corpus_size", "cycles_since", "n_points")


def signed(panels: DataFrame) -> DataFrame:
    """series, rec_id, known, current: whether a panel's W is in the series' register, and whether it is its newest."""
    register = version_register(panels)
    newest = register.groupBy("series").agg(F.max_by("w_sha", "version").alias("newest"))
    p = panels.where("mode = 'evaluation'").select("series", "rec_id", "w_sha")
    known = register.select("series", "w_sha").distinct().withColumn("known", F.lit(True))
    return p.join(known, ["series", "w_sha"], "left").join(newest, "series", "left").select("series", "rec_id", F.coalesce("known", F.lit(False)).alias("known"), (F.col("w_sha") == F.col("newest")).alias("current"))


def snapshot(panels: DataFrame) -> DataFrame:
    """The state of each series after its last message: its last panel, with the number of messages, panels and rebuilds so far."""
    last = F.max_by(F.struct(*NAMES[1:]), F.struct("t", "rec_id")).alias("r")
    g = panels.groupBy("series").agg(last, F.count("*").alias("n_messages"), F.count_if(F.col("mode") == "evaluation").alias("n_panels"), F.count_if("rebuilt").alias("n_rebuilds"))
    return g.select("series", "n_messages", "n_panels", "n_rebuilds", "r.*")
