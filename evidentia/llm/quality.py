"""Quality rules: base counts and divergence from language references (operator 4). DataFrame functions only.

Every document gets the base counts of its whole text, a histogram over character classes and one over the common words
of its language: the COMMON words, with a letter, that are most frequent in all documents of that language. References
are the same histograms summed over all documents of each language. A document is kept if it passes the base rule and
its Jensen-Shannon distances to its language's reference (the nearest of all, if it has no language) are small. Common
words cover a small part of any text, so the distance of words is measured against what each reference allows: a text
without any common word has the distance `_bare`, and a text is far beyond WORD_SHARE of it. A guard spares short
documents: a histogram of few words or characters, or one in which the reference lets expect less than GUARD_HITS common
words, says little.

Nothing is shuffled but partial counts of words and a row of counts per language; documents stay where they are. The
tables of common words and references have a row per language and are broadcast up to FEW_LANGUAGES of them, beyond that
joined as any table; a document without a language is held against each reference, so its cost grows with their number.

Defined results: null or empty text has zero counts and fails the base rule; equal rows are judged alike; empty tables
give no rows; columns with clashing names are ignored. Ties among common words go to the one that sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import shared

#: Common words of a language; languages whose tables are broadcast at most (a row of about one KB each).
COMMON, FEW_LANGUAGES = 16, 4_000
#: Hashes by which words are counted first, and hashes of a language that are broadcast at most.
WORD_BUCKETS, FEW_BUCKETS = 65_536, 200_000
#: Least characters, words and expected common words at which a histogram counts, and the largest distances of kept
#: documents: of classes as such, of words as a share of the distance of a text without common words.
GUARD_CHARS, GUARD_WORDS, GUARD_HITS = 200, 50, 5
MAX_CHAR_DISTANCE, WORD_SHARE = 0.30, 0.9
#: Base rule.
LEAST_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30

SPACE = r"\x20\x09-\x0D"
CLASSES = ("upper", "digit", "punctuation", "symbol", "space", "wide", "rest")
COUNTS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _left(pattern: str) -> Column:
    """Characters of the text that the pattern, of runs to be removed, leaves."""
    return F.length(F.regexp_replace("__t", pattern, ""))


def shares(df: DataFrame, common: DataFrame, text_col: str, lang_col: str | None, *keep: Column) -> DataFrame:
    """The kept columns, __lang, __t, __words (array), n_words, n_chars, __classes (counts) and __common (counts by word)."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    d = df.select(*keep, lang.alias("__lang"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    d = _beside(d, common)
    d = d.withColumn("__words", F.regexp_extract_all("__t", F.lit(f"[^{SPACE}]+"), F.lit(0)))
    listed = F.coalesce("__list", F.array().cast("array<string>"))
    d = d.withColumn("__hits", F.filter(F.transform("__words", F.lower), lambda x: F.array_contains(listed, x)))
    d = d.select(
        *[c for c in d.columns if c not in ("__hits", "__list")],
        F.size("__words").cast("long").alias("n_words"),
        F.length("__t").cast("long").alias("n_chars"),
        _left(f"[{SPACE}]+").cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _left("[^A-Z]+").cast("long").alias("upper"),
        _left("[^0-9]+").cast("long").alias("digit"),
        _left(r"[^.,;:!?'\"()\-]+").cast("long").alias("punctuation"),
        F.when(F.octet_length("__t") == F.length("__t"), 0).otherwise(_left(r"[\x00-\x7F]+")).cast("long").alias("wide"),
        F.map_from_entries(F.transform(F.array_distinct("__hits"), lambda x: F.struct(x, (F.size("__hits") - F.size(F.array_remove("__hits", x))).cast("long")))).alias("__common"),
    )
    space = F.col("n_chars") - F.col("word_chars")
    rest = F.col("n_chars") - sum((F.col(c) for c in ("upper", "digit", "punctuation", "n_symbols", "wide")), space)
    return d.withColumn("__classes", F.array("upper", "digit", "punctuation", "n_symbols", space, "wide", rest)).drop("upper", "digit", "punctuation", "wide")


def features(df: DataFrame, common: DataFrame, text_col: str, lang_col: str | None, *keep: Column) -> DataFrame:
    """The kept columns, __lang, n_words, n_chars, the base counts, __classes and __common."""
    d = shares(df, common, text_col, lang_col, *keep)
    d = d.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    w = REPEAT_WINDOW
    d = d.withColumn("__h", F.expr(f"IF(size(__words) >= {w}, transform(sequence(1, size(__words) - {w - 1}), i -> xxhash64(slice(__words, i, {w}))), array())"))
    d = d.withColumn("__s", F.expr("IF(size(array_distinct(__h)) = size(__h), array(), array_sort(transform(__h, (x, i) -> named_struct('h', x, 'i', i))))"))
    repeats = f"""aggregate(array_sort(transform(filter(__s, (e, k) -> (k > 0 AND __s[greatest(k - 1, 0)].h = e.h)
        OR (k < size(__s) - 1 AND __s[least(k + 1, size(__s) - 1)].h = e.h)), e -> e.i)),
        named_struct('last', -{w}, 'n', 0), (a, x) -> named_struct('last', x, 'n', a.n + least({w}, x - a.last)), a -> a.n)"""
    d = d.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).withColumn("n_repeat_words", F.expr(repeats).cast("long"))
    return d.drop("__t", "__words", "__lines", "__h", "__s")


def _beside(d: DataFrame, small: DataFrame) -> DataFrame:
    """d with the row of its language from a table (lang, one more column); a null language has a row of its own."""
    if small.count() <= FEW_LANGUAGES:
        small = F.broadcast(small)
    return d.join(small.withColumnRenamed("lang", "__key"), F.col("__lang").eqNullSafe(F.col("__key")), "left").drop("__key")


def common_words(df: DataFrame, text_col: str, lang_col: str | None) -> DataFrame:
    """lang, __list: the most frequent words of each language, and of all of them together for the null language.

    Most distinct words are rare, so they aren't all counted apart. Words are counted by WORD_BUCKETS hashes first, which
    bounds each word's count; the words of each language's largest buckets, counted apart, tell how frequent its last
    common word is at least; then the words of all buckets that reach it are counted. The result is that of a full count.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    words = df.select(lang.alias("lang"), F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"[^{SPACE}]+"), F.lit(0))).alias("w")).filter(F.col("lang").isNotNull())
    words = words.withColumn("h", F.pmod(F.xxhash64("w"), F.lit(WORD_BUCKETS)))
    count = F.count(F.lit(1)).alias("n")
    sizes = shared.save(words.groupBy("lang", "h").agg(count), "word-buckets")

    # a limit on a rank is pushed below the shuffle: each task sends so many rows of a language at most
    def largest(d: DataFrame, k: int, by: str) -> DataFrame:
        return d.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), by))).filter(F.col("k") <= k)

    def counted(some: DataFrame) -> DataFrame:
        few = F.broadcast(some) if some.count() <= FEW_BUCKETS else some
        return largest(words.join(few, ["lang", "h"], "left_semi").groupBy("lang", "w").agg(count).filter(F.col("w").rlike(r"\p{L}")), COMMON, "w")

    first = shared.save(largest(sizes, 2 * COMMON, "h").select("lang", "h"), "word-buckets")
    top = shared.save(counted(first), "common-words")
    least = top.filter(F.col("k") == COMMON).select("lang", F.col("n").alias("least"))
    reach = sizes.join(least, "lang", "left").filter(F.col("n") >= F.coalesce("least", F.lit(0))).select("lang", "h")
    if reach.join(first, ["lang", "h"], "left_anti").take(1):
        top = counted(shared.save(reach, "word-buckets"))
    own = shared.save(top.groupBy("lang").agg(F.array_sort(F.collect_list("w")).alias("__list")), "common-words")
    all_ = own.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__list")))).alias("__list"))
    return shared.save(own.unionByName(all_.select(F.lit(None).cast("string").alias("lang"), "__list")), "common-words")


def _term(p: str, q: str) -> str:
    """Twice a bin's share of the divergence."""
    return f"(IF({p} > 0, {p} * log2(2 * {p} / ({p} + {q})), 0D) + IF({q} > 0, {q} * log2(2 * {q} / ({p} + {q})), 0D))"


#: Distance of a text without common words from a reference whose common words have the share ``known`` in all.
_bare = f"sqrt(greatest(0D, 0.5D * (known + {_term('1D', 'greatest(0D, 1 - known)')})))"


def references(feats: DataFrame) -> DataFrame:
    """lang, __refs: of each language the shares of classes and common words as an array of one, and for the null language
    an array of all."""
    known = feats.filter(F.col("__lang").isNotNull())
    sums = [F.sum(F.get("__classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    total = known.groupBy(F.col("__lang").alias("lang")).agg(F.sum("n_words").alias("n"), F.sum("n_chars").alias("m"), *sums).filter("n > 0 AND m > 0")
    counts = known.select(F.col("__lang").alias("l"), F.explode("__common").alias("w", "c")).groupBy("l", "w").agg(F.sum("c").alias("c"))
    listed = counts.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("w", "c"))).alias("words"))  # COMMON at most
    d = total.join(listed, F.col("lang") == F.col("l"), "left")
    d = d.select("lang", F.array(*[F.col(f"c{i}") / F.col("m") for i in range(len(CLASSES))]).alias("classes"), F.expr("transform(coalesce(words, array()), x -> named_struct('w', x.w, 'q', x.c / n))").alias("words"))
    d = d.withColumn("known", F.expr("least(1D, aggregate(words, 0D, (a, x) -> a + x.q))"))
    d = d.select("lang", F.struct("lang", "classes", "words", "known", F.expr(f"{WORD_SHARE}D * {_bare}").alias("limit")).alias("r"))
    own = shared.save(d, "references")
    all_ = own.agg(F.array_sort(F.collect_list("r")).alias("__refs")).select(F.lit(None).cast("string").alias("lang"), "__refs")
    return shared.save(own.select("lang", F.array("r").alias("__refs")).unionByName(all_), "references")


def judge(feats: DataFrame, refs: DataFrame) -> DataFrame:
    """The rule's columns: distances to the reference, base_failed, kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    d = _beside(feats.withColumn("base_failed", failed), refs)
    chars = f"""sqrt(greatest(0D, 0.5D * aggregate(zip_with(__classes, r.classes, (c, q) -> {_term('(c / n_chars)', 'q')}), 0D, (a, x) -> a + x)))"""
    p = "(coalesce(try_element_at(__common, x.w), 0L) / n_words)"
    seen = f"aggregate(r.words, named_struct('j', 0D, 'p', 0D), (a, x) -> named_struct('j', a.j + {_term(p, 'x.q')}, 'p', a.p + {p}))"
    d = d.withColumn("__seen", F.expr(f"IF(n_words > 0, transform(coalesce(__refs, array()), r -> named_struct('s', {seen}, 'known', r.known, 'limit', r.limit, 'c', {chars})), array())"))
    words = f"sqrt(greatest(0D, 0.5D * (s.s.j + {_term('greatest(0D, 1 - s.s.p)', 'greatest(0D, 1 - s.known)')})))"
    d = d.withColumn("__near", F.expr(f"array_min(transform(__seen, s -> named_struct('sum', s.c + {words}, 'c', s.c, 'w', {words}, 'limit', s.limit, 'known', s.known)))"))
    d = d.withColumn("char_distance", F.col("__near.c")).withColumn("word_distance", F.col("__near.w"))
    told = (F.col("n_words") >= GUARD_WORDS) & (F.coalesce(F.col("n_words") * F.col("__near.known"), F.lit(0.0)) >= GUARD_HITS)
    far = (F.col("n_chars") >= GUARD_CHARS) & (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | told & (F.coalesce(F.col("word_distance") > F.col("__near.limit"), F.lit(False)))
    # through a generator, so that a filter on it isn't pushed down and the expressions below aren't repeated
    return d.withColumn("kept", F.explode_outer(F.array(~F.col("base_failed") & ~far)))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, char_distance, word_distance."""
    feats = shared.save(features(df, common_words(df, text_col, lang_col), text_col, lang_col, F.col(id_col).alias("doc_id")), "features")
    out = judge(feats, references(feats))
    return out.select("doc_id", "n_words", *COUNTS, "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows that pass, with their own columns.

    The histograms are made twice, once for the references and once beside each row with the base counts, so that no text
    is shuffled. A generator parts them from the judgement: its loops would else hold the features' expressions and
    compute them at every step.
    """
    common = common_words(df, text_col, lang_col)
    small = shared.save(shares(df, common, text_col, lang_col).select("__lang", "n_words", "n_chars", "__classes", "__common"), "shares")
    refs = references(small)
    shared.drop(small)
    feats = features(df, common, text_col, lang_col, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))
    feats = feats.select(F.explode_outer(F.array(F.struct(*feats.columns))).alias("f")).select("f.*")
    return judge(feats, refs).filter("kept").select("__row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _js(p: str, q: str) -> str:
    """Twice a bin's share of the divergence, in DuckDB's SQL."""
    return f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END)"


_COUNT = lambda pattern: f"length(regexp_replace(t, '{pattern}', '', 'g'))"
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT *, len(w) AS n_words, length(t) AS n_chars, {_COUNT(r'[\x20\x09-\x0D]')} AS word_chars, {_COUNT('[^#*$%&|<>]')} AS n_symbols, {_COUNT('[^A-Z]')} AS up, {_COUNT('[^0-9]')} AS dig,
  {_COUNT(r"[^.,;:!?''" + '"' + r"()\-]")} AS pun, {_COUNT(r'[\x00-\x7F]')} AS wide, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM h) WHERE c > 1) GROUP BY 1),
f AS (SELECT b.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, [up, dig, pun, n_symbols, n_chars - word_chars, wide, word_chars - up - dig - pun - n_symbols - wide] AS cl FROM b LEFT JOIN rep USING (doc_id)),
wd AS (SELECT doc_id, lang, lower(unnest(w)) AS x FROM d), wc AS (SELECT lang, x, count(*) AS c FROM wd WHERE lang IS NOT NULL GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, x) AS k FROM wc WHERE regexp_matches(x, '\p{{L}}')) WHERE k <= {COMMON}),
tot AS (SELECT lang, sum(n_words) AS n, sum(n_chars) AS m, [{', '.join(f'sum(cl[{i}])' for i in range(1, 8))}] AS cs FROM f WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) > 0 AND sum(n_chars) > 0),
ref AS (SELECT tot.lang AS l, [c / m FOR c IN cs] AS qs, coalesce(sum(c / n) FILTER (WHERE c IS NOT NULL), 0) AS known FROM tot LEFT JOIN top ON top.lang = tot.lang GROUP BY tot.lang, cs, m),
pr AS (SELECT f.doc_id, l, known, n_words, n_chars, cl, qs FROM f JOIN ref ON f.lang = l OR f.lang IS NULL WHERE n_words > 0),
dc AS (SELECT doc_id, x, count(*) AS c FROM wd GROUP BY ALL),
pw AS (SELECT pr.doc_id, pr.l, coalesce(dc.c, 0) / pr.n_words AS p, top.c / tot.n AS q FROM pr JOIN top ON top.lang = pr.l JOIN tot ON tot.lang = pr.l LEFT JOIN dc ON dc.doc_id = pr.doc_id AND dc.x = top.x),
ws AS (SELECT doc_id, l, sum({_js('p', 'q')}) AS j, sum(p) AS p FROM pw GROUP BY ALL),
di AS (SELECT pr.doc_id, known, sqrt(greatest(0, 0.5 * (coalesce(j, 0) + {_js('greatest(0, 1 - coalesce(ws.p, 0))', 'greatest(0, 1 - known)')}))) AS wdist,
  sqrt(greatest(0, 0.5 * list_sum([{_js('(cl[i] / n_chars)', 'qs[i]')} FOR i IN range(1, 8)]))) AS cdist FROM pr LEFT JOIN ws ON ws.doc_id = pr.doc_id AND ws.l = pr.l),
ne AS (SELECT doc_id, arg_min({{'c': cdist, 'w': wdist, 'known': known}}, cdist + wdist) AS x FROM di GROUP BY doc_id),
v AS (SELECT f.*, x, x.known AS known, n_words < {LEAST_WORDS} OR {REPEAT_WINDOW - 7} * 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM f LEFT JOIN ne USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(x.c, 6) AS char_distance, round(x.w, 6) AS word_distance,
NOT base_failed AND NOT (n_chars >= {GUARD_CHARS} AND coalesce(x.c, 0) > {MAX_CHAR_DISTANCE} OR n_words >= {GUARD_WORDS} AND coalesce(n_words * known, 0) >= {GUARD_HITS}
  AND coalesce(x.w > {WORD_SHARE} * sqrt(greatest(0, 0.5 * (known + {_js('1', 'greatest(0, 1 - known)')}))), false)) AS kept FROM v
"""
