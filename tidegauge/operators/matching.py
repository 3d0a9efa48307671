"""Filter rules against URLs by one automaton of the rules' literals.

Every match of a rule holds one of a few literal strings, one for each alternative of its pattern. All of them, of any
length, go into one Aho-Corasick automaton, which is built once in each worker process and run over Arrow batches of
URLs; a URL then meets the patterns of those rules only whose literals it holds. Nothing is joined on words, so a word that every
URL holds costs nothing unless it is the longest literal of a rule.

Rules are numbered and dealt into shards of at most ``SHARD_RULES``; what goes to the driver, and from there to the workers, is
one shard's literals, and the shards follow one another. Rules without any literal are laid out in arrays of ``LOOSE_RULES``, and
each URL is tested against an array at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.plans.checkpoints import cut

#: Rules whose literals are in one automaton, and rules without a literal that a URL meets at once, at most.
SHARD_RULES, LOOSE_RULES = 100_000, 500
_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    """A to Z in lower case and nothing else, so that a part of a text is a part of the lowered text."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def _closing(regex: str, at: int) -> int:
    """Where the group or class that opens at a place ends (behind its last character)."""
    if regex[at] == "[":
        i = at + 1 + (regex[at + 1 : at + 2] == "^")
        i += regex[i : i + 1] == "]"
        while i < len(regex) and regex[i] != "]":
            i += 2 if regex[i] == "\\" else _closing(regex, i) - i if regex[i] == "[" and regex[i : i + 2] != "[:" else 1
        return i + 1
    i = at + 1
    while i < len(regex) and regex[i] != ")":
        i = i + 2 if regex[i] == "\\" else _closing(regex, i) if regex[i] in "[(" else i + 1
    return i + 1


def literals(regex: str) -> list[str]:
    """Strings, in lower case, of which every match holds one; none if some match may hold no literal.

    Each alternative gives its longest run of characters that stand for themselves: groups, classes and what may be absent
    end a run. Patterns with comments, quoting or inline flags other than ``i`` give none.
    """
    if re.search(r"\(\?[a-hj-zA-Z-]|\(\?#|\\[QExuc0-9pPNk]", regex):
        return []
    runs: list[list[str]] = [[""]]  # of each alternative
    i, n = 0, len(regex)
    while i < n:
        c = regex[i]
        if c == "|":
            runs.append([""])
            i += 1
            continue
        if c == "\\" and i + 1 < n:
            one, i = (regex[i + 1] if not regex[i + 1].isalnum() else None), i + 2
        elif c in "[(":
            one, i = None, _closing(regex, i)
        elif c in ".^$":
            one, i = None, i + 1
        else:
            one, i = c, i + 1
        quantity = re.match(r"[*?+]|\{[^}]*\}", regex[i:])
        if one is None:
            runs[-1].append("")
        elif quantity is None:
            runs[-1][-1] += lowered(one)
            continue
        elif quantity.group() == "+":
            runs[-1][-1] += lowered(one)
            runs[-1].append("")
        else:
            runs[-1].append("")
        if quantity:
            i += len(quantity.group())
            i += regex[i : i + 1] in ("?", "+")
    best = [max(r, key=len) for r in runs]
    return sorted(set(best)) if all(best) else []


_BUILT: dict = {}


def _automaton(key: str, words: dict[str, list[int]]):
    """The automaton of one shard; a worker keeps the last one."""
    if key not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        a = ahocorasick.Automaton()
        for w, ids in words.items():
            a.add_word(w, ids)
        a.make_automaton()
        _BUILT[key] = a
    return _BUILT[key]


def candidates(urls: DataFrame, url: str, literal_rows: list, key: str) -> DataFrame:
    """(url, id) of the rules of a shard, given as rows (id, literals), whose literals a URL holds."""
    words: dict[str, list[int]] = {}
    for r in literal_rows:
        for w in r["literals"]:
            words.setdefault(w, []).append(r["id"])
    given = urls.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, given.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                out = []
                for u in batch.column(0).slice(lo, 4096).to_pylist():
                    found = {i for _, ids in automaton.iter(lowered(u)) for i in ids} if u else ()
                    out += [(u, i) for i in found]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], [url, "id"])

    return urls.mapInArrow(run, f"`{url}` string, id long")


def hits(urls: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """(url, list, kind, raw) of each URL and each rule (list, kind, raw, regex, literals) whose pattern it matches."""
    held = cut(rules.select("list", "kind", "raw", "regex", "literals").withColumn("id", F.monotonically_increasing_id()))
    n, loose = held.agg(F.count("*"), F.coalesce(F.sum((F.size("literals") == 0).cast("long")), F.lit(0))).first()
    shards = max(1, -(-(n - loose) // (SHARD_RULES * 4 // 5)))  # a shard by hash has its mean share and a little more
    out = None
    for i in range(shards):
        part = held.filter((F.size("literals") > 0) & (F.pmod(F.xxhash64("id"), F.lit(shards)) == i))
        rows = part.select("id", "literals").collect()
        if not rows:
            continue
        key = f"{id(held)}-{n}-{i}-{rows[0]['id']}-{hash(tuple(w for r in rows for w in r['literals']))}"
        found = candidates(urls.select(url), url, rows, key).join(F.broadcast(part.drop("literals")), "id")
        found = found.filter(F.expr(f"`{url}` rlike regex")).select(url, "list", "kind", "raw")
        out = found if out is None else out.unionByName(found)
    bare = held.filter(F.size("literals") == 0).withColumn("_a", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, -(-loose // LOOSE_RULES)))))
    for i in range(-(-loose // SHARD_RULES)):
        # arrays of rules, so that a URL is one row for each array and not for each rule
        arrays = bare.filter(F.pmod("_a", F.lit(-(-loose // SHARD_RULES))) == i).groupBy("_a").agg(F.collect_list(F.struct("list", "kind", "raw", "regex")).alias("_r"))
        met = urls.select(url).join(F.broadcast(arrays)).select(F.col(url), F.explode(F.expr(f"filter(_r, r -> `{url}` rlike r.regex)")).alias("r")).select(url, "r.list", "r.kind", "r.raw")
        out = met if out is None else out.unionByName(met)
    return out if out is not None else urls.sparkSession.createDataFrame([], f"`{url}` string, list string, kind string, raw string")
