"""Quality rules, line first: bad lines go, then documents that lost too much.

Every line is held against punctuation, navigation and boilerplate rules. Lines that
fail are removed; a document that loses more than ``MAX_LOSS`` of its word characters,
or fails the base rules on its whole text, is rejected. All work is inside one row and
uses DataFrame functions only, so nothing is shuffled and no key can be hot.

Defined results: a null text has no words and is rejected with the base rules; an empty
one too; lines without a word are neither removed nor counted; repeated rows and rows
without an id are judged alike; an empty table gives an empty table; columns named like
the added ones are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: White space between words; all else is a word.
SPACE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Share of words in repeated 3-word windows, in percent, beyond which a text fails.
MAX_REPEAT = 50
#: Share of word characters that a document may lose with its lines.
MAX_LOSS = 0.5
#: Punctuation: a line fails with more than this many symbols for each word, ...
MAX_SYMBOLS = 0.3
#: ... with more than this share of its words shouted (ending in two marks), ...
MAX_SHOUTED = 0.3
#: ... or with no closing mark and fewer words than this.
OPEN_WORDS = 5
CLOSING = ".!?…:;,\"”»)]}。！？"
#: Navigation: so many separators between short items.
SEPARATORS = 3
#: Boilerplate: phrases that make a line of up to BOILERPLATE_WORDS words no content.
BOILERPLATE = (r"(?i)all rights reserved|\blicen[sc]ed? (under|v)|is licensed under|released under|terms of (use|service)|privacy policy|cookie (policy|settings)"
               r"|javascript (is|must be) |click here|sign up for|subscribe to|copyright (©|\(c\)|[0-9]{4})")
BOILERPLATE_WORDS = 20

NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_removed_lines", "lost_share", "kept", "clean_text"]


def words_of(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT))


def squeezed(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, SPACE, "")


def repeated_words(words: str, bits: int = 20) -> dict[str, Column]:
    """Words inside 3-word windows that occur twice or more, from an array column.

    The windows' hashes are compared as a set first. Only where some are equal, hash
    and position are sorted together (packed into one long up to 2**bits words, which
    sorts as a primitive), neighbours are compared by the full hash, and the covered
    words are counted from the sorted positions.
    """
    h, n = F.col("__h"), F.size("__h")

    def cover(pos: Column) -> Column:
        after = F.slice(pos, F.lit(2), F.greatest(F.size(pos) - 1, F.lit(0)))
        return F.aggregate(F.zip_with(pos, after, lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)).cast("int"))), F.lit(0), lambda s, x: s + x)

    def same(a: Column, b: Column) -> Column:
        at = lambda x: F.get(h, x.bitwiseAND(F.lit(2**bits - 1)).cast("int"))
        return F.coalesce(at(a) == at(b), F.lit(False))

    packed = F.col("__sorted")
    few = F.filter(packed, lambda x, i: same(x, F.get(packed, i - 1)) | same(x, F.get(packed, i + 1)))
    few_pos = F.sort_array(F.transform(few, lambda x: x.bitwiseAND(F.lit(2**bits - 1))))
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("bigint").alias("i"))))
    many = F.filter(F.col("__pairs"), lambda x, i: F.coalesce(x["h"] == F.get(F.col("__pairs"), i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(F.col("__pairs"), i + 1)["h"], F.lit(False)))
    many_pos = F.sort_array(F.transform(many, lambda x: x["i"]))
    return {
        "__h": F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))),
        "__repeats": F.size(F.array_distinct(h)) < n,
        "__sorted": F.when(F.col("__repeats") & (n < 2**bits), F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-(2**bits))).bitwiseOR(i.cast("bigint"))))),
        "__pairs": F.when(F.col("__repeats") & (n >= 2**bits), pairs),
        "n_repeat_words": F.when(~F.col("__repeats"), F.lit(0)).when(n < 2**bits, cover(few_pos)).otherwise(cover(many_pos)).cast("bigint"),
    }


def line_fails(line: Column, n_words: Column, n_chars: Column) -> Column:
    """Whether a line with ``n_words`` words and ``n_chars`` word characters is to go."""
    symbols = n_chars - F.length(F.translate(squeezed(line), SYMBOLS, ""))
    shouted = F.size(F.split(line, r"(?:!!|\?\?)(?:[\x20\x09-\x0D]|$)")) - 1
    last = F.substring(F.rtrim(line, F.lit(SPACE)), -1, 1)
    punctuation = (symbols > MAX_SYMBOLS * n_words) | (shouted > MAX_SHOUTED * n_words) | ((n_words < OPEN_WORDS) & ~F.contains(F.lit(CLOSING), last))
    separators = F.size(F.split(line, r" (?:\||>|»|›|·|•) ")) - 1
    navigation = (separators >= SEPARATORS) & (separators * 5 >= n_words - separators)
    boilerplate = (n_words <= BOILERPLATE_WORDS) & F.regexp_like(line, F.lit(BOILERPLATE))
    return punctuation | navigation | boilerplate


def quality_rules(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Adds the base counts, the lines' verdict and, with ``keep_text``, clean_text: the lines that stay."""
    new = NEW if keep_text else NEW[:-1]
    d = docs.drop(*NEW).withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    d = d.withColumn("__words", words_of(F.col("__text")))
    for name, c in repeated_words("__words").items():
        d = d.withColumn(name, c)
    bare = squeezed(F.col("__text"))
    d = d.select(
        *[c for c in docs.columns if c not in NEW], "__text", "n_repeat_words", F.size("__words").cast("bigint").alias("n_words"),
        F.length(bare).cast("bigint").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"), F.split("__text", "\n").alias("__lines"))
    # per line: its text, its words, its word characters; lines without a word have none
    told = F.transform("__lines", lambda x: F.struct(x.alias("line"), F.size(words_of(x)).alias("w"), F.length(squeezed(x)).alias("c")))
    d = d.withColumn("__told", told)
    d = d.withColumn("__told", F.transform("__told", lambda x: F.struct(x["line"].alias("line"), x["w"].alias("w"), x["c"].alias("c"), ((x["w"] > 0) & line_fails(x["line"], x["w"], x["c"])).alias("bad"))))
    d = d.withColumn("__full", F.transform(F.filter("__told", lambda x: x["w"] > 0), lambda x: x["line"])).withColumn("__bad", F.filter("__told", lambda x: x["bad"]))
    lost = F.aggregate("__bad", F.lit(0), lambda s, x: s + x["c"])
    d = d.select(
        *[c for c in docs.columns if c not in NEW], "n_words", "word_chars", "n_symbols",
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("bigint").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))).alias("base_failed"),
        F.size("__full").cast("bigint").alias("n_lines"), F.size("__bad").cast("bigint").alias("n_removed_lines"),
        F.when(F.col("word_chars") > 0, lost / F.col("word_chars")).otherwise(F.lit(0.0)).alias("lost_share"),
        F.when(F.size("__bad") == 0, F.col("__text")).otherwise(F.array_join(F.transform(F.filter("__told", lambda x: ~x["bad"]), lambda x: x["line"]), "\n")).alias("clean_text"))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= MAX_LOSS))
    # a filter on the result isn't pushed below a generator; written out in place of each column it would evaluate all of this many times
    return d.select(*[c for c in docs.columns if c not in NEW], F.explode_outer(F.array(F.struct(*new))).alias("__q")).select(*[c for c in docs.columns if c not in NEW], "__q.*")


_WORD = r"[^\x20\x09-\x0D]+"
_BARE = "translate({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws, length({_BARE.format("text")}) AS chars FROM d),
e AS (SELECT r, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT r, i, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o AS g FROM e WINDOW o AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM n, range(3) t(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, line, len(regexp_extract_all(line, '{_WORD}')) AS w, length({_BARE.format("line")}) AS c, length(line) - length(translate(line, '{SYMBOLS}', '')) AS symbols,
             len(regexp_extract_all(line, '(?:!!|\?\?)(?:[\x20\x09-\x0D]|$)')) AS shouted, len(regexp_extract_all(line, ' (?:\||>|»|›|·|•) ')) AS seps
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
t AS (SELECT *, symbols > {MAX_SYMBOLS} * w OR shouted > {MAX_SHOUTED} * w
                OR (w < {OPEN_WORDS} AND NOT contains('{CLOSING}', right(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), 1)))
                OR (seps >= {SEPARATORS} AND seps * 5 >= w - seps) OR (w <= {BOILERPLATE_WORDS} AND regexp_matches(line, '{BOILERPLATE}')) AS bad FROM l WHERE w > 0),
s AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dups, count(*) FILTER (bad) AS removed, coalesce(sum(c) FILTER (bad), 0) AS lost FROM t GROUP BY r),
x AS (SELECT doc_id, len(ws) AS n_words, chars AS word_chars, length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(removed, 0) AS n_removed_lines, CASE WHEN chars > 0 THEN lost::DOUBLE / chars ELSE 0.0 END AS lost_share
      FROM w LEFT JOIN rep USING (r) LEFT JOIN s USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND lost_share <= {MAX_LOSS} AS kept FROM x
"""
