"""Text functions as column expressions; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed

DEVANAGARI, TELUGU, LATIN = "[ऀ-ॿ]", "[ఀ-౿]", "[a-zA-Z]"


def tokens(text: Column) -> Column:
    """All tokens in order: URLs and mail addresses are blanked, pure ASCII tokens are lower-cased."""
    plain = F.coalesce(text, F.lit(""))
    plain = F.when(F.contains(plain, F.lit("://")) | F.contains(plain, F.lit("www.")), F.regexp_replace(plain, "(?U)" + fixed.URL, " ")).otherwise(plain)
    # An address always takes the whole run of characters it lies in, so that the search begins at runs only.
    plain = F.when(F.contains(plain, F.lit("@")), F.regexp_replace(plain, r"(?U)(?<!\S)" + fixed.EMAIL, " ")).otherwise(plain)
    found = F.regexp_extract_all(plain, F.lit(f"({fixed.TOKEN})"), 1)
    return F.transform(found, lambda t: F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(t))


def is_indexed(token: Column) -> Column:
    """Whether the index keeps a token: its length, and no stopword. Numbers of any length stay."""
    return F.length(token).between(fixed.MIN_TOKEN, fixed.MAX_TOKEN) & ~token.isin(fixed.STOPWORDS)


def is_searched(token: Column) -> Column:
    """Whether a query keeps a token: as the index does, but for numbers of under five digits."""
    number = F.length(F.regexp_replace(token, r"\p{Nd}", "")) == 0
    return is_indexed(token) & (~number | (F.length(token) >= fixed.MIN_NUMBER))


def terms(text: Column) -> Column:
    return F.filter(tokens(text), is_searched)


def _scripts(text: Column) -> tuple[Column, Column, Column, Column]:
    hindi, telugu, latin = (F.regexp_count(text, F.lit(x)) for x in (DEVANAGARI, TELUGU, LATIN))
    return hindi, telugu, latin, hindi + telugu + latin


def language(text: Column) -> Column:
    """hi, te, en or mixed by the share of letters of each script; en without letters."""
    hindi, telugu, latin, total = _scripts(F.coalesce(text, F.lit("")))
    return (
        F.when(total == 0, "en").when(hindi / total > fixed.INDIC_SHARE, "hi").when(telugu / total > fixed.INDIC_SHARE, "te").when(latin / total > fixed.LATIN_SHARE, "en").otherwise("mixed")
    )


def language_label(text: Column) -> Column:
    """Hindi, Telugu or English of the first 500 characters, as shown with a result; en without letters."""
    hindi, telugu, _, total = _scripts(F.substring(F.coalesce(text, F.lit("")), 1, fixed.LANGUAGE_CHARS))
    return F.when(total == 0, "en").when(hindi / total > fixed.INDIC_SHARE, "Hindi").when(telugu / total > fixed.INDIC_SHARE, "Telugu").otherwise("English")


def windows(text: Column, n: int) -> Column:
    """Every n characters in a row."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngrams(text: Column, n: int = 2) -> Column:
    """Character n-grams of every searched token between marks of its ends."""
    return F.flatten(F.transform(terms(text), lambda t: _marked(t, n)))


def _marked(term: Column, n: int) -> Column:
    return windows(F.concat(F.lit("$"), term, F.lit("$")), n)


def ngram_counts(docs: DataFrame, n: int = 2) -> DataFrame:
    """ngram and its number in all texts. Terms are counted first, and each term is cut once for all its copies."""
    counted = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
    return counted.select(F.explode(_marked(F.col("term"), n)).alias("ngram"), "times").groupBy("ngram").agg(F.sum("times").alias("n"))


def stem_of(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]+$", "")


def normal_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(stem_of(name)), "[_-]", " "), r"(?U)\s+", " "))


def file_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kind, extensions in fixed.FILE_TYPES.items() for e in extensions for x in (e, kind)])
    return F.coalesce(known[F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))], F.lit("unknown"))


def with_name_terms(text: Column, path: Column) -> Column:
    """text and, after a blank line, the file's name, its tags and its search terms, each once in the order of the name."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.lower(stem_of(path)), r"[_\-.]", " "), r"(?U)\s+", " "))
    parts = F.array_distinct(F.split(name, " "))

    def listed(table: dict[str, list[str]]) -> Column:
        known = F.create_map(*[x for word, values in table.items() for x in (F.lit(word), F.array(*map(F.lit, values)))])
        return F.array_distinct(F.flatten(F.transform(parts, lambda w: F.coalesce(known[w], F.array().cast("array<string>")))))

    words = F.concat_ws(" ", F.array(name), listed(fixed.FILENAME_TAGS), listed(fixed.FILENAME_TERMS))
    return F.when(name == "", F.coalesce(text, F.lit(""))).otherwise(F.concat(F.coalesce(text, F.lit("")), F.lit("\n\n"), words))


def embedding_input(text: Column, is_query: bool) -> Column:
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.when(plain == "", "").otherwise(F.concat(F.lit("query: " if is_query else "passage: "), plain))


def rerank_input(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), 1, fixed.RERANK_CHARS)


def snippet(text: Column, query: str, size: int = fixed.SNIPPET_CHARS) -> Column:
    """The characters around the first place of any word of the query, a third of them before it."""
    text = F.coalesce(text, F.lit(""))
    lower, words = F.lower(text), list(dict.fromkeys(query.lower().split()))
    places = [F.nullif(F.locate(w, lower), F.lit(0)) for w in words]
    first = F.least(*places) if len(places) > 1 else places[0] if places else F.lit(None).cast("int")
    begin = F.greatest(F.lit(0), first - 1 - fixed.SNIPPET_LEAD)
    end = F.least(F.length(text), begin + size)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    around = F.concat(F.when(begin > 0, "...").otherwise(""), strip(F.substr(text, begin + 1, end - begin)), F.when(end < F.length(text), "...").otherwise(""))
    head = F.concat(F.substring(text, 1, size), F.when(F.length(text) > size, "...").otherwise(""))
    return F.when(first.isNull(), head).otherwise(around)


def plain_query(query: Column) -> Column:
    """A query without operators, wildcards and outer quotes, for an encoder."""
    text = F.regexp_replace(F.regexp_replace(query, r"(?iU)\b(AND|OR|NOT)\b", " "), "[*?]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, '^"+|"+$', ""), "^'+|'+$", ""))


def is_heading(line: Column) -> Column:
    upper = (F.upper(line) == line) & (F.lower(line) != line) & (F.size(F.split(F.trim(line), r"\s+")) <= 6)
    return (F.length(line) > 6) & (line.endswith(":") | upper | line.rlike(r"(?i)^(section|chapter|unit)\s+\d+"))


def synonym_form(text: Column, lang: Column) -> Column:
    return F.when(lang == "en", F.lower(F.trim(text))).otherwise(F.trim(text))
