"""Schemas that drift between files: one table from JSON files whose fields come, go, move and change type.

Schema graphs of names, types and nesting are matched by similarity flooding; the
correspondences that are consistent with how often fields occur together are selected, and
with them all files are cast into one table and compared with their predecessors.
The graphs hold fields, never rows, so they are matched on the driver whatever the number of files.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.operators.ranking import grouped_rank
from lumenset.scratch import Scratch

#: Abbreviations in field names.
ABBREVIATIONS = {"attn": "attention", "att": "attention"}
#: How well a value of one JSON type converts to another.
TYPE_AFFINITY = {("boolean", "number"): 0.6, ("boolean", "string"): 0.5, ("string", "number"): 0.5, ("array", "string"): 0.6}
TRUE_WORDS, FALSE_WORDS = ("true", "on", "yes", "1"), ("false", "off", "no", "0")

_LEAF = "array<struct<path:string,kind:string,value:string>>"


@dataclass(frozen=True)
class Target:
    """A field of the consistent table: its name and the type it is cast to (``string`` or ``boolean``)."""

    name: str
    kind: str


TRAINING_FIELDS = (Target("attention_head", "string"), Target("use_fft", "boolean"), Target("backbone", "string"))


def _kind(v: object) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _leaves(v: object, at: tuple[str, ...] = ()) -> Iterator[tuple[str, str, str | None]]:
    stack = [(at, v)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict) and v:
            stack += [((*at, k.replace(".", "․")), x) for k, x in v.items()]
        elif at:
            text = v if isinstance(v, str) else "_".join(x if isinstance(x, str) else json.dumps(x) for x in v) if isinstance(v, list) else json.dumps(v)
            yield ".".join(at), _kind(v), None if v is None else text


def _strict(name: str) -> None:
    raise ValueError(name)


def parse_files(files: DataFrame, section: str = "config", text: str = "summary_json", keep: tuple[str, ...] = ("file_id", "series", "run_no")) -> DataFrame:
    """The columns ``keep`` and ``leaves``: path, JSON type and value of each leaf of ``section``.

    Files that are not valid JSON (also NULL, blank, cut off, or with NaN and the like) are left out. A valid
    file without the section, or in which it is no object, has no leaves. An empty object is a leaf.
    Lists are leaves; as a value their elements are joined with ``_``.
    """
    out = pa.schema([pa.field("i", pa.int64()), pa.field("leaves", pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("value", pa.string())])))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, leaves = [], []
            for i, t in enumerate(b.column(text).to_pylist()):
                try:
                    doc = json.loads(t, parse_constant=_strict) if t is not None else _strict("null")
                except (ValueError, RecursionError):
                    continue
                part = doc.get(section) if isinstance(doc, dict) else None
                rows.append(i)
                leaves.append([{"path": p, "kind": k, "value": v} for p, k, v in _leaves(part)] if isinstance(part, dict) else [])
            kept = b.select(list(keep)).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(leaves, out.field("leaves").type)], names=[*keep, "leaves"])

    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    return files.select(*keep, text).mapInArrow(parse, f"{kinds}, leaves {_LEAF}")


def name_words(name: str) -> list[str]:
    """Words of a field name; abbreviations are led back to their word."""
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    split = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", split)
    return [ABBREVIATIONS.get(w, w) for w in re.split(r"[^a-z0-9]+", split.lower()) if w]


def word_similarity(a: str, b: str) -> float:
    """Dice coefficient of letter pairs."""
    if a == b:
        return 1.0
    x, y = ({w[i : i + 2] for i in range(len(w) - 1)} for w in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


@dataclass
class _Graph:
    edges: dict[str, set[tuple[str, str]]] = field(default_factory=lambda: defaultdict(set))
    nodes: set[str] = field(default_factory=set)

    def add(self, a: str, label: str, b: str) -> None:
        self.edges[label].add((a, b))
        self.nodes |= {a, b}


def schema_graph(fields: dict[str, set[str]]) -> _Graph:
    """Nodes for nesting levels, fields, words of names, types and the values a field holds. ``fields``: path to its JSON types."""
    g = _Graph()
    for path, kinds in fields.items():
        parts = path.split(".")
        above = "level:"
        for i in range(1, len(parts)):
            level = "level:" + ".".join(parts[:i])
            g.add(above, "holds", level)
            above = level
        g.add(above, "holds", f"field:{path}")
        for w in name_words(path):
            g.add(f"field:{path}", "word", f"word:{w}")
        for k in kinds - {"null"}:
            g.add(f"field:{path}", "type", f"type:{k}")
        g.add(f"field:{path}", "values", f"values:{path}")
    return g


def flood(a: _Graph, b: _Graph, start: dict[tuple[str, str], float], rounds: int = 200, until: float = 1e-6) -> dict[tuple[str, str], float]:
    """Similarity flooding: every pair of nodes passes its score on to the pairs it is connected with by edges of one label, until nothing changes.

    An edge pair's weight is one divided by the number of such pairs that leave its node. Each round adds the start
    scores and what flows in, and scales to a maximum of one.
    """
    pairs: dict[tuple[str, str], int] = {p: i for i, p in enumerate(start)}
    src, dst, weight = [], [], []
    for label in a.edges.keys() & b.edges.keys():
        out, back = defaultdict(list), defaultdict(list)
        for a1, a2 in a.edges[label]:
            for b1, b2 in b.edges[label]:
                out[a1, b1].append((a2, b2))
                back[a2, b2].append((a1, b1))
        for links in (out, back):
            for p, to in links.items():
                for q in to:
                    src.append(pairs.setdefault(p, len(pairs)))
                    dst.append(pairs.setdefault(q, len(pairs)))
                    weight.append(1 / len(to))
    first = np.zeros(len(pairs))
    for p, s in start.items():
        first[pairs[p]] = s
    score, src, dst, weight = first.copy(), np.array(src, int), np.array(dst, int), np.array(weight)
    for _ in range(rounds):
        both = first + score
        new = both + np.bincount(dst, both[src] * weight, minlength=len(pairs)) if len(src) else both
        new = new / max(new.max(initial=0), 1e-12)
        done = np.abs(new - score).max(initial=0) < until
        score = new
        if done:
            break
    return {p: float(score[i]) for p, i in pairs.items()}


def name_score(path: str, target: str) -> float:
    """How well a path's words cover a target's."""
    wx, wy = name_words(path), name_words(target)
    return sum(max(word_similarity(u, v) for u in wx) for v in wy) / len(wy) if wx and wy else 0.0


def field_scores(fields: dict[str, set[str]], overlap: dict[tuple[str, str], float], targets: tuple[Target, ...], rounds: int = 200) -> dict[str, dict[str, float]]:
    """For each path its flooded score with each target, relative to the target's best one.

    Words, types and values start with their similarity, fields with a third of that of their names: a field without a like name scores by
    what flows in from its values, types, words and the level that holds it. ``overlap``: how alike the values of path and target are.
    """
    goal, seen = schema_graph({t.name: {t.kind} for t in targets}), schema_graph(fields)
    start: dict[tuple[str, str], float] = {("level:", "level:"): 1.0}
    for x in seen.nodes:
        for y in goal.nodes:
            (kx, _, nx), (ky, _, ny) = x.partition(":"), y.partition(":")
            if kx != ky or kx == "level":
                continue
            if kx == "type":
                s = 1.0 if nx == ny else TYPE_AFFINITY.get((nx, ny), TYPE_AFFINITY.get((ny, nx), 0.1))
            elif kx == "word":
                s = word_similarity(nx, ny) ** 2
            elif kx == "values":
                s = overlap.get((nx, ny), 0.0)
            else:
                s = 0.3 * name_score(nx, ny)
            if s > 0:
                start[x, y] = s
    score = flood(seen, goal, start, rounds)
    table = {p: {t.name: score.get((f"field:{p}", f"field:{t.name}"), 0.0) for t in targets} for p in fields}
    top = {t.name: max((r[t.name] for r in table.values()), default=0.0) for t in targets}
    best = {p: max(r.values(), default=0.0) for p, r in table.items()}
    # A path stands for the target it scores highest with, and for no other.
    return {p: {n: v / top[n] for n, v in r.items() if v > 0 and v >= best[p]} for p, r in table.items()}


def select_matches(scores: dict[str, dict[str, float]], together: dict[tuple[str, str], int], count: dict[str, int], targets: tuple[Target, ...], least: float = 0.2, tolerance: float = 0.02) -> dict[str, list[tuple[str, float]]]:
    """The paths that stand for each target, best first: selection by relative threshold among paths that exclude each other.

    ``together``: in how many files two paths (in order) are both present. A path is taken if it scores ``least`` of the target's best
    and occurs beside a better path of the target in at most ``tolerance`` of its files, as one field has one place in a
    file. The target's own name leads; it is where the others have to fit in.
    """
    out: dict[str, list[tuple[str, float]]] = {}
    for t in targets:
        chosen: list[tuple[str, float]] = []
        for p in sorted((p for p in scores if t.name in scores[p]), key=lambda p: (p != t.name, -scores[p][t.name], p)):
            s = scores[p][t.name]
            both = [together.get((min(p, q), max(p, q)), 0) for q, _ in chosen]
            if p == t.name or s >= least and all(n <= tolerance * max(1, count.get(p, 0)) for n in both):
                chosen.append((p, s))
        out[t.name] = chosen
    return out


def value_overlap(leaf: DataFrame, targets: tuple[Target, ...], few: float = 20.0) -> DataFrame:
    """(``path``, ``target``, ``overlap``): how alike the values of a path and those under a target's own name are, 0 to 1.

    For a path with many values that is what the two distributions have in common; for one with ``few`` it is led by the share of
    its texts, lists and truth values that the target has too, as so few values show no distribution. Each value is counted once for each path, so
    frequent ones cost nothing.
    """
    told = leaf.where("kind <> 'null' and value is not null")
    values = told.groupBy("path", F.lower(F.trim("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") != "number").alias("worded"))
    total = values.groupBy("path").agg(F.sum("n").alias("total"))
    values = values.join(total, "path")
    goal = values.where(F.col("path").isin([t.name for t in targets])).select(F.col("path").alias("target"), "value", (F.col("n") / F.col("total")).alias("share"), (F.col("worded") > 0).alias("said"))
    both = values.join(goal, "value").groupBy("path", "target").agg(F.sum(F.least(F.col("n") / F.col("total"), "share")).alias("common"), (F.sum(F.when(F.col("said"), F.col("worded")).otherwise(0)) / F.max("total")).alias("held"), F.max("total").alias("n"))
    return both.select("path", "target", ((F.col("n") * F.col("common") + few * F.col("held")) / (F.col("n") + few)).alias("overlap"))


def learn_matches(parsed: DataFrame, targets: tuple[Target, ...] = TRAINING_FIELDS, most_fields: int = 100_000, least: float = 0.2) -> dict[str, list[tuple[str, float]]]:
    """``select_matches`` with the statistics of all files. More than ``most_fields`` different paths raise ValueError.

    What reaches the driver has a row for each path and type, for each path and target, and for each two paths that could stand for one target.
    """
    leaf = parsed.select(F.explode("leaves").alias("l")).select("l.*")
    kinds = leaf.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")).limit(6 * most_fields + 1).collect()
    fields: dict[str, set[str]] = defaultdict(set)
    count: dict[str, int] = defaultdict(int)
    for r in kinds:
        fields[r["path"]].add(r["kind"])
        count[r["path"]] += r["n"] * (r["kind"] != "null")
    if len(fields) > most_fields:
        raise ValueError(f"more than {most_fields} different fields")
    overlap = {(r["path"], r["target"]): r["overlap"] for r in value_overlap(leaf, targets).collect()}
    scores = field_scores(fields, overlap, targets)
    # Only paths that score for the same target can be rivals for its place.
    rivals = {t.name: [p for p, r in scores.items() if p == t.name or r.get(t.name, 0) >= least] for t in targets}
    together: dict[tuple[str, str], int] = {}
    for paths in rivals.values():
        if len(paths) < 2:
            continue
        held = F.filter("leaves", lambda x: (x["kind"] != "null") & x["path"].isin(paths))
        # Files of one shape are counted first, so pairs are made once for each shape.
        shapes = parsed.select(F.array_sort(F.transform(held, lambda x: x["path"])).alias("s")).where(F.size("s") > 1).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
        pair = shapes.select("n", F.explode("s").alias("a"), "s").select("n", "a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.sum("n").alias("n"))
        together |= {(r["a"], r["b"]): r["n"] for r in pair.toLocalIterator()}
    return select_matches(scores, together, count, targets, least)


def resolved_files(parsed: DataFrame, matches: dict[str, list[tuple[str, float]]], keep: tuple[str, ...] = ("file_id", "series", "run_no")) -> DataFrame:
    """``keep`` and, for each target, the struct ``<name>`` (path, kind, value) of the best of its paths that is present, or NULL."""

    def pick(paths: list[tuple[str, float]]) -> Column:
        present = F.filter("leaves", lambda x: (x["kind"] != "null"))
        at = lambda p: F.filter(present, lambda x: x["path"] == p)
        found = [at(p) for p, _ in paths]
        return F.get(F.concat(*found), F.lit(0)) if found else F.lit(None).cast("struct<path:string,kind:string,value:string>")

    return parsed.select(*keep, *[pick(paths).alias(name) for name, paths in matches.items()])


def unified_table(resolved: DataFrame, targets: tuple[Target, ...] = TRAINING_FIELDS, keep: tuple[str, ...] = ("file_id", "series", "run_no")) -> DataFrame:
    """One column and type for each target. A value that has no meaning in the target's type gives NULL."""

    def cast(t: Target) -> Column:
        v = F.col(t.name)["value"]
        if t.kind == "boolean":
            w = F.lower(F.trim(v))
            return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)
        return v

    return resolved.select(*keep, *[cast(t).alias(t.name) for t in targets])


def field_changes(resolved: DataFrame, targets: tuple[Target, ...] = TRAINING_FIELDS) -> DataFrame:
    """(``file_id``, ``field_name``, ``change_kind``): each change against the file before it in its series.

    Files of a series are ordered by ``run_no``, then ``file_id``; NULL numbers come first, and files without a series
    form one of their own. ``added`` and ``removed`` tell presence, ``renamed`` another path, ``retyped`` another of the JSON types
    string, number, boolean and array; a field may be renamed and retyped at once.
    """
    names = [t.name for t in targets]
    ranked = Scratch(resolved.sparkSession, "drift").write(grouped_rank(resolved, ["series"], [F.col("run_no"), F.col("file_id")], "nth"), "ranked")
    now = ranked.where("nth > 1").select("file_id", F.col("series"), F.col("nth"), *[F.col(n).alias(f"now_{n}") for n in names])
    was = ranked.select(F.col("series").alias("s"), (F.col("nth") + 1).alias("n"), *[F.col(n).alias(f"was_{n}") for n in names])
    both = now.join(was, (F.col("nth") == F.col("n")) & F.col("series").eqNullSafe(F.col("s")))

    def kinds(n: str) -> Column:
        a, b = F.col(f"was_{n}"), F.col(f"now_{n}")
        known = F.array(*[F.lit(k) for k in ("string", "number", "boolean", "array")])
        stays = a.isNotNull() & b.isNotNull()
        found = F.array(
            F.when(a.isNull() & b.isNotNull(), "added"),
            F.when(a.isNotNull() & b.isNull(), "removed"),
            F.when(stays & (a["path"] != b["path"]), "renamed"),
            F.when(stays & (a["kind"] != b["kind"]) & F.array_contains(known, a["kind"]) & F.array_contains(known, b["kind"]), "retyped"),
        )
        return F.transform(F.filter(found, lambda k: k.isNotNull()), lambda k: F.struct(F.lit(n).alias("field_name"), k.alias("change_kind")))

    return both.select("file_id", F.explode(F.concat(*[kinds(n) for n in names])).alias("c")).select("file_id", "c.*")


def drift(files: DataFrame, targets: tuple[Target, ...] = TRAINING_FIELDS) -> tuple[DataFrame, DataFrame, dict[str, list[tuple[str, float]]]]:
    """The unified table, the list of changes and the selected correspondences of all files."""
    parsed = Scratch(files.sparkSession, "parsed").write(parse_files(files), "parsed")
    matches = learn_matches(parsed, targets)
    resolved = resolved_files(parsed, matches)
    return unified_table(resolved, targets), field_changes(resolved, targets), matches
