"""URL filters: rules first; else a word model of the host and path decides.

Host labels are parted into words by the most probable way under word counts (Viterbi). The
words of host and path are the tokens of a multinomial naive Bayes model, trained on the urls the
rules decide. No word or token is left out of the models: all counts stay in Spark, and chunks of
hosts and paths ask for those they need.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm.common import add_columns, ascii_lower, checkpointed, fields

#: Keys, and rows, of a chunk that asks for counts together.
CHUNK_KEYS = 100_000
#: A host or path of more than one page in so many is hot: its pages are dealt over _SALTS tasks.
_HOT_SHARE, _SALTS = 200, 64

#: Rules as (rule, verdict); a rule is host, slash, start of the path.
Rule = tuple[str, str]

# The rules of the result as defined.
RULES: tuple[Rule, ...] = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)


@dataclass(frozen=True)
class UrlParams:
    """`smoothing` is added to every count of the naive Bayes model."""

    smoothing: float = 1.0


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path; both empty for a null url or one without ://."""
    whole = F.coalesce(F.col(url).cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.withColumns(
        {
            "host": ascii_lower(F.regexp_extract(whole, pattern, 1)),
            "path": F.regexp_extract(whole, pattern, 2),
        }
    )


def rule_column(rules: Iterable[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, null if none does; of equal rules the first listed."""
    chosen = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chosen = F.when(fits, rule).otherwise(chosen)
    return chosen


def title_words(pages: DataFrame, html: str = "html") -> DataFrame:
    """word, n: the a-z words of the titles of all pages."""
    title = F.regexp_extract(ascii_lower(F.coalesce(html, F.lit(""))), r"(?s)<title>(.*?)</title>", 1)
    words = pages.select(F.explode(F.split(title, "[^a-z]+")).alias("word"))
    return words.where(F.length("word") > 0).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Segmenter:
    """Parts a run of letters into words: counted ones, of at most `longest` letters, by their
    share of the total (default: of the counts given), others, of any length, by a share that
    falls tenfold with each letter."""

    def __init__(self, counts: dict[str, int], longest: int, total: int | None = None) -> None:
        self.total, self.longest = total or sum(counts.values()) or 1, longest
        self.cost = {w: -math.log10(n / self.total) for w, n in counts.items()}

    def _unknown(self, length: int) -> float:
        return math.log10(self.total) + length - 1

    def __call__(self, letters: str) -> list[str]:
        best, start = [0.0], [0]
        cheapest = (0.0, 0)  # of all starts of an unknown word, without its cost up to the end
        for end in range(1, len(letters) + 1):
            # A counted word never costs more than an unknown one would.
            ways = [(cheapest[0] + self._unknown(end), cheapest[1])]
            for a in range(max(0, end - self.longest), end):
                known = self.cost.get(letters[a:end])
                if known is not None:
                    ways.append((best[a] + known, a))
            cost, a = min(ways)  # of equal ways the longest last word
            best.append(cost)
            start.append(a)
            cheapest = min(cheapest, (cost - end, end))
        words, end = [], len(letters)
        while end:
            words.append(letters[start[end] : end])
            end = start[end]
        return words[::-1]


def _runs(text: str) -> list[str]:
    """Runs of letters and of digits, other characters parting them."""
    parts, kind = [], ""
    for c in text:
        now = "d" if c.isdigit() else "a" if c.isalpha() else ""
        if now and now == kind:
            parts[-1] += c
        elif now:
            parts.append(c)
        kind = now
    return parts


def url_tokens(segment: Callable[[str], list[str]], host: str, path: str) -> list[str]:
    """Tokens: h: words of the host, p: words of the path; a number is its length in digits."""
    tokens = []
    for run in _runs(host):
        words = segment(run) if _is_word(run) else [run]
        tokens += ["h:" + (w if w.isalpha() else f"#{len(w)}") for w in words]
    return tokens + ["p:" + (w if w.isalpha() else f"#{len(w)}") for w in _runs(path.lower())]


def _is_word(run: str) -> bool:
    return run.isalpha() and run.isascii()


def _looked_up(
    rows: DataFrame,
    answers: DataFrame,
    ask: Callable[[str, list[str]], Iterable[str]],
    use: Callable[[str, list[str], dict], object],
    kind: str,
    chunk_keys: int,
) -> DataFrame:
    """name, result: `use` of each row (name, parts) and the answers (key, value) to what it asks.

    Rows are read in chunks that ask for some `chunk_keys` distinct keys, each of them once, so a
    key has at most as many rows as there are chunks, however common it is.
    """
    asked_schema = fields(names="array<string>", parts="binary", keys="array<string>")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, keys = [], [], set()

        def out() -> pa.RecordBatch:
            stored = [[names], [json.dumps(parts).encode()], [list(keys)]]
            types = [pa.list_(pa.string()), pa.binary(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(stored, types, strict=True)], names=asked_schema.names)

        for batch in batches:
            for name, own in zip(*(batch.column(c).to_pylist() for c in ("name", "parts")), strict=True):
                names.append(name)
                parts.append(own)
                keys.update(ask(name, own))
                if len(keys) + len(names) >= chunk_keys:
                    yield out()
                    names, parts, keys = [], [], set()
        if names:
            yield out()

    chunks = rows.select("name", "parts").mapInArrow(gather, asked_schema)
    chunks = checkpointed(chunks.withColumn("chunk", F.monotonically_increasing_id()))
    asked = chunks.select("chunk", F.explode("keys").alias("key"))
    found = asked.join(answers, "key").select(
        "chunk", F.lit(0).alias("kind"), "key", "value", F.lit(None).cast("array<string>").alias("names"), F.lit(None).cast("binary").alias("parts")
    )
    texts = chunks.select(
        "chunk", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"), "names", "parts"
    )
    # The answers of a chunk come first; then its rows.
    together = found.union(texts).repartition("chunk").sortWithinPartitions("chunk", "kind")
    schema = fields(name="string", result=kind)
    result_type = to_arrow_type(schema["result"].dataType)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            kinds, keys, values = (batch.column(c).to_pylist() for c in ("kind", "key", "value"))
            for at, row_kind in enumerate(kinds):
                if row_kind == 0:
                    known[keys[at]] = values[at]
                    continue
                names, parts = batch.column("names")[at].as_py(), json.loads(batch.column("parts")[at].as_py())
                results = [use(n, p, known) for n, p in zip(names, parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(results, result_type)], names=schema.names)
                known = {}

    return together.mapInArrow(answer, schema)


def _attached(df: DataFrame, key: str, table: DataFrame, columns: list[str], hot: list[str]) -> DataFrame:
    """df with the columns of the table's row of the same key; rows of hot keys are dealt over
    _SALTS copies of it."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS))
    salted = df.withColumn("_url_salt", F.when(F.col(key).isin(hot), salt).otherwise(F.lit(0).cast("long")))
    every = F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))
    copies = F.when(F.col("_url_key").isin(hot), every).otherwise(F.array(F.lit(0).cast("long")))
    table = table.select(F.col(key).alias("_url_key"), *columns).withColumn("_url_copy", F.explode(copies))
    same = (salted[key] == table["_url_key"]) & (salted["_url_salt"] == table["_url_copy"])
    return salted.join(table, same, "left").drop("_url_key", "_url_copy", "_url_salt")


def judge_urls(
    pages: DataFrame,
    rules: Iterable[Rule] = RULES,
    params: UrlParams = UrlParams(),
    url: str = "url",
    html: str = "html",
    chunk_keys: int = CHUNK_KEYS,
) -> DataFrame:
    """Add host, path, rule, verdict, host_words and block_odds to every row.

    The verdict is the rule's; without one it is block where the model's log odds of block are
    above 0, else allow, so a tie allows. Word and token counts cover all pages, and all of them
    make up the models; they stay in Spark and are joined. Null urls and those without :// have an
    empty host and path, no rule and no tokens: the commoner verdict among ruled urls, and allow
    where there are none. Repeated rows count each time and are judged alike, an empty table stays
    empty, very long urls are read whole, input columns of the names added are replaced.
    """
    verdict_of = dict(reversed(list(rules)))
    alpha = params.smoothing
    judged = with_host_and_path(pages, url)
    judged = judged.withColumn("rule", rule_column(verdict_of.items(), F.col("host"), F.col("path")))
    is_block = F.col("rule").isin(*(r for r, v in verdict_of.items() if v == "block")).cast("int")
    # Of a host, and of a path, all pages together: urls blocked and allowed by rules, and all.
    marked = judged.select("host", "path", F.coalesce(is_block, F.lit(0)).alias("b"), F.coalesce(1 - is_block, F.lit(0)).alias("a"))
    sums = [F.sum("b").alias("b"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("n")]
    hosts, paths = (checkpointed(marked.groupBy(key).agg(*sums)) for key in ("host", "path"))
    urls = hosts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "ban")).first()
    hot = {
        key: [r[key] for r in df.where(F.col("n") * _HOT_SHARE > urls["n"]).select(key).collect()]
        for key, df in (("host", hosts), ("path", paths))
    }

    words = checkpointed(title_words(pages, html))
    facts = words.agg(F.sum("n").alias("total"), F.collect_set(F.length("word")).alias("lengths")).first()
    total, lengths = facts["total"] or 1, sorted(facts["lengths"])

    def substrings(host: str, _: list[str]) -> Iterator[str]:
        for run in filter(_is_word, _runs(host)):
            for n in lengths:
                if n > len(run):
                    break
                yield from (run[i : i + n] for i in range(len(run) - n + 1))

    def parted(host: str, _: list[str], counts: dict) -> list[str]:
        longest = lengths[-1] if lengths else 0

        def segment(run: str) -> list[str]:
            own = {w: counts[w] for w in substrings(run, []) if w in counts}
            return Segmenter(own, longest, total)(run)

        return url_tokens(segment, host, "")

    none = F.array().cast("array<string>")
    asking = hosts.select(F.col("host").alias("name"), none.alias("parts"))
    word_counts = words.select(F.col("word").alias("key"), F.col("n").cast("double").alias("value"))
    of_host = _looked_up(asking, word_counts, substrings, parted, "array<string>", chunk_keys)
    of_host = of_host.select(F.col("name").alias("host"), F.col("result").alias("tokens"))
    hosts = checkpointed(hosts.join(of_host, "host"))

    def path_tokens():
        return lambda column: ([url_tokens(list, "", p) for p in column.to_pylist()],)

    paths = add_columns(paths, ["path"], fields(tokens="array<string>"), path_tokens)
    spelt = hosts.select("b", "a", "tokens").union(paths.select("b", "a", "tokens"))
    counts = spelt.where("a + b > 0").select("b", "a", F.explode("tokens").alias("token"))
    counts = checkpointed(counts.groupBy("token").agg(*sums[:2]))
    seen = counts.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("size")).first()
    down = [(seen[c] or 0) + alpha * (seen["size"] + 1) for c in "ba"]  # and the unknown token
    unknown = math.log(alpha / down[0]) - math.log(alpha / down[1])
    bias = math.log(urls["b"] + alpha) - math.log(urls["a"] + alpha)
    share = [F.log((F.col(c) + alpha) / F.lit(d)) for c, d in zip("ba", down, strict=True)]
    weights = counts.select(F.col("token").alias("key"), (share[0] - share[1]).alias("value"))

    def own_tokens(_: str, tokens: list[str]) -> list[str]:
        return tokens

    def odds(_: str, tokens: list[str], weight: dict) -> float:
        return math.fsum(weight.get(t, unknown) for t in tokens)

    # Hosts and paths are scored together, told apart by their first letter.
    asking = hosts.select(F.concat(F.lit("h"), "host").alias("name"), F.col("tokens").alias("parts")).union(
        paths.select(F.concat(F.lit("p"), "path"), "tokens")
    )
    scored = checkpointed(_looked_up(asking, weights, own_tokens, odds, "double", chunk_keys))
    bare = F.expr("substring(name, 2)")
    host_odds, path_odds = (
        scored.where(F.col("name").startswith(side)).select(bare.alias(key), F.col("result").alias(f"_url_{key}_odds"))
        for side, key in (("h", "host"), ("p", "path"))
    )
    host_words = F.transform("tokens", lambda t: F.substring(t, 3, 2**31 - 1))
    host_facts = hosts.join(host_odds, "host").select("host", host_words.alias("_url_words"), "_url_host_odds")

    # The row in one struct, so that its columns may have any names.
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(judged.columns)))
    found = _attached(judged.select(row.alias("row"), "host", "path"), "host", host_facts, ["_url_words", "_url_host_odds"], hot["host"])
    found = _attached(found, "path", path_odds, ["_url_path_odds"], hot["path"])
    own = {c: F.col(f"row.c{i}") for i, c in enumerate(judged.columns)}
    block_odds = F.lit(bias) + F.col("_url_host_odds") + F.col("_url_path_odds")
    by_rule = F.when(own["rule"].isNull(), None)
    for rule, verdict in verdict_of.items():
        by_rule = by_rule.when(own["rule"] == rule, verdict)
    by_model = F.when(block_odds > 0, "block").otherwise("allow")
    made = own | {"host_words": F.col("_url_words"), "block_odds": block_odds, "verdict": F.coalesce(by_rule, by_model)}
    return found.select(*(column.alias(c) for c, column in made.items()))
