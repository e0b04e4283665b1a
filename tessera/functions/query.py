"""Queries on the driver: one string in, the parsed query out. The rules are the columns' rules for a single text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessera import fixed

#: What is no white space for the columns' patterns; Python's own class leaves out four control characters more.
_OTHER = r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A mail address always takes the whole run it lies in, so that the search begins at runs only.
_URL, _EMAIL, _TOKEN = re.compile(fixed.URL.replace(r"\S", _OTHER)), re.compile(f"(?<!{_OTHER})" + fixed.EMAIL.replace(r"\S", _OTHER)), re.compile(fixed.TOKEN)
_STOP = frozenset(fixed.STOPWORDS)


def raw_tokens(text: str) -> list[str]:
    """All tokens in order, in the case they have."""
    if "://" in text or "www." in text:
        text = _URL.sub(" ", text)
    return _TOKEN.findall(_EMAIL.sub(" ", text) if "@" in text else text)


def searched(token: str) -> str | None:
    """The term that a query makes of a token, if it keeps it."""
    term = token.lower() if token.isascii() else token
    kept = fixed.MIN_TOKEN <= len(term) <= fixed.MAX_TOKEN and term not in _STOP and (len(term) >= fixed.MIN_NUMBER or not term.isdecimal())
    return term if kept else None


def searched_terms(text: str) -> list[str]:
    return [t for t in map(searched, raw_tokens(text)) if t is not None]


def language(text: str) -> str:
    hindi, telugu, latin = (len(re.findall(x, text)) for x in ("[ऀ-ॿ]", "[ఀ-౿]", "[a-zA-Z]"))
    total = hindi + telugu + latin
    if not total:
        return "en"
    if hindi / total > fixed.INDIC_SHARE:
        return "hi"
    if telugu / total > fixed.INDIC_SHARE:
        return "te"
    return "en" if latin / total > fixed.LATIN_SHARE else "mixed"


def is_boolean(query: str) -> bool:
    return any(f" {word} " in query.upper() for word in ("AND", "OR", "NOT"))


def is_phrase(query: str) -> bool:
    """Quotes at both ends; a lone quote is both."""
    return query[:1] in ("'", '"') and query[0] == query[-1]


def is_wildcard(query: str) -> bool:
    return "*" in query or "?" in query


def is_short(query: str, most: int = fixed.SHORT_QUERY) -> bool:
    """One to `most` searched terms."""
    return 0 < len(searched_terms(query)) <= most


def plain(query: str) -> str:
    text = re.sub(r"\b(AND|OR|NOT)\b", " ", query, flags=re.IGNORECASE)
    return re.sub("[*?]", "", text).strip('"').strip("'").strip()


@dataclass
class Query:
    raw: str
    type: str
    terms: list[str]
    language: str = "en"
    original_terms: list[str] = field(default_factory=list)
    expanded_terms: list[str] = field(default_factory=list)
    weighted_terms: dict[str, float] = field(default_factory=dict)
    expandable: bool = False
    expand_reason: str = "unknown"
    intent: list[str] = field(default_factory=list)
    intent_terms: list[str] = field(default_factory=list)
    use_weighted_embedding: bool = False


def expandable(terms: list[str], lang: str) -> tuple[bool, str]:
    if not terms:
        return False, "empty_query"
    if len(terms) > fixed.SHORT_QUERY:
        return False, "too_many_tokens"
    if len(terms) == 1:
        return True, "single_word_query"
    key = lang if lang in fixed.SYNONYMS else "en"
    words = [t.lower() for t in terms] if key == "en" else terms
    if " ".join(words) in fixed.STRONG_PHRASES[key]:
        return False, "strong_phrase"
    if not set(words).isdisjoint(fixed.TECHNICAL_TERMS[key]):
        return False, "technical_phrase"
    if set(words) <= set(fixed.GENERIC_TERMS[key]):
        return True, "generic_multi_term_query"
    return False, "specific_multi_term_query"


def expand(terms: list[str], lang: str, synonyms: dict | None = None) -> tuple[list[str], dict[str, float], bool, str]:
    """Added synonyms, weights of all terms, whether the query may be expanded and why."""
    weights = dict.fromkeys(terms, fixed.ORIGINAL_WEIGHT)
    may, why = expandable(terms, lang)
    if not terms:
        return [], {}, False, "unknown"
    added: list[str] = []
    if may:
        table = (fixed.SYNONYMS if synonyms is None else synonyms).get(lang if lang in fixed.SYNONYMS else "en", {})
        for term in terms:
            new = [s.strip() for s in table.get(term.lower(), []) if isinstance(s, str) and s.strip()]
            new = [s for s in dict.fromkeys(new) if s not in weights][: fixed.SYNONYMS_PER_TERM]
            added += new
            weights |= dict.fromkeys(new, fixed.EXPANDED_WEIGHT)
    return added, weights, may, why


def intents(query: str, terms: list[str]) -> list[str]:
    words, text = {t.lower() for t in terms}, query.lower()
    return [name for name, keys in fixed.INTENT_KEYWORDS.items() if any(k in text if " " in k else k in words for k in keys)]


def intent_terms(names: list[str]) -> list[str]:
    return list(dict.fromkeys(t for name in names for t in fixed.INTENT_TERMS.get(name, [])))[: fixed.INTENT_MAX_TERMS]


def weighted(query: str, weights: dict[str, float], canonical: list[str]) -> dict[str, float]:
    """Weights with intents, boosts, phrase expansions and trigger expansions, in this order."""
    text, out = query.lower(), dict(weights)
    for term in canonical:
        out.setdefault(term, fixed.INTENT_WEIGHT)
    for term in fixed.TERM_BOOSTS.keys() & out.keys():
        out[term] = max(out[term], fixed.TERM_BOOSTS[term])
    for key, terms in fixed.PHRASE_EXPANSIONS.items():
        if key in text:
            out |= {t: max(out.get(t, 0.0), fixed.PHRASE_EXPANSION_WEIGHT) for t in terms}
    for key, terms in fixed.TRIGGER_EXPANSIONS.items():
        if key in text:
            out |= {t: fixed.EXPANDED_WEIGHT for t in terms if t not in out}
    words = set(text.split())
    return {t: max(w, fixed.ORIGINAL_WEIGHT) if t in words else w for t, w in out.items()}


def parse(query: str, synonyms: dict | None = None) -> Query:
    """Empty, boolean, phrase, wildcard, else free text: the first that fits."""
    text = (query or "").strip()
    if not text:
        return Query(query or "", "empty", [], expand_reason="empty_query")
    lang = language(text)

    def bare(raw: str, kind: str, terms: list[str]) -> Query:
        return Query(raw, kind, terms, lang, terms, [], dict.fromkeys(terms, 1.0), expand_reason=f"{kind}_query")

    if is_boolean(text):
        return bare(text, "boolean", searched_terms(text))
    if is_phrase(text):
        inner = text.strip('"').strip("'")
        return bare(inner, "phrase", searched_terms(inner))
    if is_wildcard(text):
        return bare(text, "wildcard", [text.lower()])
    terms = searched_terms(text)
    added, weights, may, why = expand(terms, lang, synonyms)
    names = intents(text, terms)
    canonical = intent_terms(names)
    weights = weighted(text, weights, canonical)
    return Query(text, "free_text", list(weights), lang, terms, added, weights, may, why, names, canonical, bool(canonical or added))


def fusion_weights(query: Query) -> tuple[float, float]:
    """Of the keyword and of the semantic list: digits and short queries favour words, long ones meaning."""
    n = len(query.original_terms or query.terms)
    keyword = fixed.KEYWORD_WEIGHT + (fixed.DIGIT_BOOST if re.search(r"\d", query.raw) else 0) + (fixed.SHORT_BOOST if 1 <= n <= 2 else 0)
    semantic = fixed.SEMANTIC_WEIGHT + (fixed.LONG_BOOST if n >= 6 else 0)
    return max(keyword, fixed.LEAST_WEIGHT), max(semantic, fixed.LEAST_WEIGHT)


def clean_synonyms(table: dict[str, dict[str, list[str]]], most: int = fixed.SYNONYMS_PER_TERM) -> dict[str, dict[str, list[str]]]:
    """Close synonyms only: not the term itself, not broad, of as many words, each once, most for each term."""
    out: dict[str, dict[str, list[str]]] = {}
    for lang, entries in table.items():
        form = (lambda s: s.strip().lower()) if lang == "en" else str.strip
        broad = set(fixed.BROAD_TERMS.get(lang, []))
        out[lang] = {}
        for term, synonyms in entries.items():
            good: dict[str, str] = {}
            for s in synonyms:
                if isinstance(s, str) and s.strip() and form(s) not in {form(term), *broad} and len(s.split()) == len(term.split()):
                    good.setdefault(form(s), s.strip())
            if good:
                out[lang][term] = list(good.values())[:most]
    return out
