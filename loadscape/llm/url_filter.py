"""URL filter: rules first, then words segmented out of host names and scored by naive Bayes.

Unigram counts over the words of all pages feed a Viterbi search that splits run-together letters of hosts and paths
into words. The distinct runs are cut into their substrings (up to MAX_WORD letters, told by the run's number, so linear in the length), which
are joined to the whole unigram table; each run then gathers its known words and is split by itself. The tokens
of the urls that a rule decides, counted over all of them, train a multinomial naive Bayes model, which judges the
urls that no rule decides: tokens are joined to the whole table of their counts and the weights summed by url. No
table is cut or collected; tokens and runs that very many urls share are dealt to SALTS tasks.

Defined results: a null url or one without `://` has an empty host and path, fits no rule and is judged by the
prior; user info and port stay part of the host; host A-Z is lower-cased, the path is kept; a word has at most MAX_WORD
letters, as a host label has; a url of any length is split in linear time; of splits as likely, the one with the longer
last words counts; a token that no ruled url has weighs nothing; with no rule-decided urls the prior is even and ties
allow; rows that repeat or share a page_id, or have a null one, are each judged and reported; no rows give no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscape.llm.common import kept

#: (verdict, host, path prefix); a rule fits its host and the subdomains, the longest wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: MAX_WORD: the letters of a host label. Words of up to SHORT letters are in most runs, and at most 26 + 26^2 + 26^3.
MAX_WORD, SHORT, SMOOTHING, SALTS = 63, 3, 0.5, 16
STARTS, _FLUSH = 1024, 200_000
#: What a letter of an unknown word costs, beside ten times less than the rarest word.
LETTER = 2.3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    # the length of a rule is that of host and path together; a longer host wins a tie
    for verdict, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        made = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def unigrams(pages: DataFrame, text_col: str = "html") -> DataFrame:
    """word, n of all words of all pages."""
    words = pages.select(F.explode(F.split(F.translate(F.col(text_col), _UPPER, _LOWER), "[^a-z]+")).alias("word")).filter(F.length("word").between(1, MAX_WORD))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split(run: str, known: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a run of letters; known: the counts of its substrings that are words."""
    unknown = math.log(total * 10)
    cost = {w: math.log(total / n) for w, n in known.items()}
    longest = max(map(len, cost), default=0)
    best, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        # a longer unknown word never costs less than an unknown letter behind the best split, so one letter at least
        options = []
        for size in range(1, min(MAX_WORD, end) + 1):
            own = cost.get(run[end - size : end]) if size <= longest else None
            options.append((best[end - size] + (own if own is not None else unknown + LETTER * size), -size))
        least, size = min(options)
        best.append(least)
        back.append(end + size)
    words, end = [], len(run)
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def substrings(runs: DataFrame) -> DataFrame:
    """id and word of every substring of up to MAX_WORD letters of runs (id, run); those that start within STARTS letters come once, so rows are linear in the letters."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = [], []
            for i, run in zip(batch["id"].to_pylist(), batch["run"].to_pylist()):
                for at in range(0, len(run), STARTS):
                    own = {run[a : a + size] for a in range(at, min(at + STARTS, len(run))) for size in range(1, min(MAX_WORD, len(run) - a) + 1)}
                    ids += [i] * len(own)
                    words += own
                    if len(words) > _FLUSH:
                        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "word": pa.array(words, pa.string())})
                        ids, words = [], []
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "word": pa.array(words, pa.string())})

    return runs.select("id", "run").mapInArrow(cut, "id long, word string")


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """run and words of each of the distinct runs of letters."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    runs = kept(runs.withColumn("id", F.monotonically_increasing_id()), "url-distinct-runs")
    parts, short = substrings(runs), F.length("word") <= SHORT
    known = parts.filter(short).join(F.broadcast(counts.filter(short)), "word").unionByName(parts.filter(~short).join(counts.filter(~short), "word"))
    found = known.groupBy("id").agg(F.collect_list("word").alias("known"), F.collect_list("n").alias("counts"))

    def search(run: pd.Series, known: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([split(r, {} if w is None else dict(zip(w, n)), max(1, total)) for r, w, n in zip(run, known, counts)])

    return runs.join(found, "id", "left").select("run", F.pandas_udf(search, "array<string>")("run", "known", "counts").alias("words"))


def _salted(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with a left join to table by key; rows of one key are dealt to SALTS tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(table.select("*", salts), [key, "salt"], "left").drop("salt")


def tokens(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """row, block (the rule's verdict), place and token, h:word of the host or p:word of the path; numbers count by their length only."""
    cut = lambda side, text: F.transform(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("([a-z]+|[0-9]+)"), F.lit(1)), lambda x: F.struct(F.lit(side).alias("side"), x.alias("run")))
    runs = parts.select("row", (F.col("fit.verdict") == "block").alias("block"), F.posexplode(F.concat(cut("h:", F.col("host")), cut("p:", F.col("path")))).alias("place", "x")).select("row", "block", "place", "x.side", "x.run")
    runs = kept(runs, "url-runs")
    letters = F.substring("run", 1, 1) > "9"
    words = segmented(runs.filter(letters).select("run").distinct(), counts)
    split_up = _salted(runs.filter(letters), words, "run").select("row", "block", "place", "side", F.posexplode("words").alias("nth", "word"))
    numbers = runs.filter(~letters).select("row", "block", "place", "side", F.lit(0).alias("nth"), F.concat(F.lit("#"), F.least(F.length("run"), F.lit(9))).alias("word"))
    return split_up.unionByName(numbers).select("row", "block", F.struct("place", "nth").alias("place"), F.concat("side", "word").alias("token"))


def weights(found: DataFrame, urls: tuple[int, int]) -> tuple[DataFrame, float]:
    """token and weight (its log odds of block), and the prior log odds; urls: the urls that rules allow and block."""
    hit = lambda block: F.sum((F.col("block") == F.lit(block)).cast("long"))
    counted = kept(found.filter("block is not null").groupBy("token").agg(hit(False).alias("a"), hit(True).alias("b")), "url-tokens")
    n, a, b = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    rate = lambda c, all_: F.log((F.col(c) + SMOOTHING) / (all_ + SMOOTHING * (n + 1)))
    return counted.select("token", (rate("b", b) - rate("a", a)).alias("weight")), math.log((urls[1] + 1) / (urls[0] + 1))


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, words (the host's, segmented), score (log odds of block by the model)."""
    host, path = split_url()
    parts = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path")).withColumn("fit", ruled(F.col("host"), F.col("path"), rules))
    parts = kept(parts, "url-parts")
    verdicts = {r["v"]: r["n"] for r in parts.groupBy(F.col("fit.verdict").alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = kept(tokens(parts, kept(unigrams(pages), "url-unigrams")), "url-words")
    weight, prior = weights(found, (verdicts.get("allow", 0), verdicts.get("block", 0)))
    of_host = F.transform(F.array_sort(F.collect_list(F.when(F.col("token").startswith("h:"), F.struct("place", "token")))), lambda x: F.substring(x["token"], 3, 1 << 30))
    # weights are summed in the order of tokens, so that a rerun gives the same last digit
    scored = _salted(found, weight, "token").groupBy("row").agg(F.array_join(of_host, " ").alias("words"), F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("w"))
    score = F.aggregate("w", F.lit(0.0), lambda s, x: s + F.coalesce(x["weight"], F.lit(0.0)))
    scored = scored.select("row", "words", score.alias("score"))
    out = parts.join(scored, "row", "left").withColumn("score", F.lit(prior) + F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("words", F.lit("")).alias("words"), "score")
