"""Text analysis as Column functions: folding, tokens, language, and the exact forms as Arrow UDFs."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: Function words by grammatical role. Ours: kept short, folded, one list for each language that can be guessed.
STOPWORDS = {
    "en": "a an and are as at be been but by can could did do does for from had has have he her him his how i if in into is it its me my no nor not of on or our she should so than that the their them then there these they this those to was we were what when where which who whom why will with would you your".split(),
    "es": "a al aunque cada como con cual cuando de del desde donde el ella ellas ellos en entre era es esa ese eso esta este esto fue ha han hasta hay la las le les lo los mas me mi muy ni no nos o para pero por porque que quien se segun ser si sin sobre son su sus tambien te tras tu un una uno unos y ya yo".split(),
}
TOKEN = r"[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)*"
_TOKEN = regex.compile(TOKEN)
#: Latin-1 characters that no token has, as blanks; an underscore is decided in its word.
_LATIN = bytes(i if i == ord("_") or _TOKEN.match(chr(i)) else ord(" ") for i in range(256))
#: Values that a Python worker turns into objects at once, and tokens that it sorts at once: what it holds besides an Arrow batch.
VALUES, TOKENS = 256, 1 << 17


def folded(text: Column) -> Column:
    """Key form: lower case, outer blanks trimmed. Text is taken to be NFKC; ``exact_fold`` does without that."""
    return F.trim(F.lower(text))


def sliced(f, kind: str):
    """A Column function that applies ``f`` to the values of every row, few rows at a time, so that a worker holds the Arrow batch
    and its result, not their objects."""

    def made(*columns: Column | str) -> Column:
        arrow = to_arrow_type(_parse_datatype_string(kind))

        def array(*values: pa.Array) -> pa.Array:
            done = [pa.array([f(*x) for x in zip(*(v.slice(i, VALUES).to_pylist() for v in values))], arrow) for i in range(0, len(values[0]), VALUES)]
            return pa.concat_arrays(done) if done else pa.array([], arrow)

        return F.arrow_udf(array, kind)(*columns)

    return made


def mapped(f, kind: str):
    """A Column function that applies ``f`` to every value."""
    return sliced(f, kind)


def runs(sizes: np.ndarray, most: int = TOKENS, rows: int = 1024):
    """(first, number) of runs of rows with about ``most`` items by their sizes and at most so many rows; a larger row is alone."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        held = ends[at - 1] if at else 0
        n = max(1, min(rows, int(np.searchsorted(ends, held + most, side="right")) - at))
        yield at, n
        at += n


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def encoded(words: list[str] | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, the place of every word among them)."""
    coded = (words if isinstance(words, pa.Array) else pa.array(words, pa.string())).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def normalize(text: Column | str) -> Column:
    """NFKC and case fold, the exact form of what ``tokens`` lowers."""
    return mapped(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold(), "string")(text)


def exact_fold(text: Column | str) -> Column:
    """NFKC, case fold and strip: the exact key form where the input isn't normalised."""
    return mapped(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold().strip(), "string")(text)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of two characters or more, an underscore between them joining; null gives none."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.coalesce(F.filter(found, lambda t: F.length(t) >= 2), F.array().cast("array<string>"))


def language(words: Column) -> Column:
    """'en' or 'es', whichever has more function words in ``words``; ties and none give 'en'."""
    spanish, english = (F.size(F.filter(words, lambda t: t.isin(STOPWORDS[k]))) for k in ("es", "en"))
    return F.when(spanish > english, "es").otherwise("en")


def stem(token: str, lang: str) -> str:
    """Identity: the degraded form for a missing stemmer, which every score here is defined with."""
    return token


def query_tokens(text: str) -> list[str]:
    """Tokens of a query without function words, in order and once each; a query of function words alone keeps them."""
    return list(dict.fromkeys(_content(analyse(text), None)[0]))


def analyse(text: str) -> list[str]:
    """Tokens of a text on the driver, as ``tokens`` gives them."""
    low = text.lower()
    try:
        words = low.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        words = _TOKEN.findall(low)
    else:
        if "_" in low:
            words = [t for w in words for t in (_TOKEN.findall(w) if "_" in w else (w,))]
    return [t for t in words if len(t) >= 2]


def _content(found: list[str], lang: str | None) -> tuple[list[str], list[str]]:
    """(content tokens, languages to stem in). Without a function word nothing tells the language, so both are taken."""
    hits = {k: sum(t in v for t in found) for k, v in STOPWORDS.items()}
    if lang in STOPWORDS:
        langs = [lang]
    else:
        guess = "es" if hits["es"] > hits["en"] else "en"
        langs = [guess] if hits[guess] else ["en", "es"]
    return [t for t in found if t not in STOPWORDS[langs[0]]] or found, langs


def query_terms(text: str, lang: str | None = None) -> list[str]:
    """The terms of a query in both spaces, stems (t:) and raw tokens (x:), once each."""
    content, langs = _content(analyse(text), lang)
    return list(dict.fromkeys(term for t in content for term in [*(f"t:{stem(t, x)}" for x in langs), f"x:{t}"]))


def query_groups(text: str, lang: str | None = None) -> list[list[str]]:
    """The same terms, one group for each token: ALL asks for one of every group."""
    content, langs = _content(analyse(text), lang)
    return [list(dict.fromkeys([*(f"t:{stem(t, x)}" for x in langs), f"x:{t}"])) for t in content]


def phrase_terms(text: str) -> list[str]:
    """The raw tokens of a phrase in order, function words too."""
    return [f"x:{t}" for t in analyse(text)]


#: Where a chunk may end, best first.
MARKS = ("\n\n", ". ", "\n", " ")


def chunk_spans(text: str | None, size: int = 1600, overlap: int = 200) -> list[tuple[int, int, int, str]]:
    """(position, start, end, piece) of the trimmed text: pieces of at most ``size`` characters, trimmed, that share ``overlap``;
    one ends behind the best mark in its last ``overlap`` characters, where there is one."""
    body = (text or "").strip()
    out, at = [], 0
    while at < len(body):
        stop = min(len(body), at + size)
        if stop < len(body):
            low = max(at, stop - overlap)
            cuts = ((body.rfind(m, low, stop), m) for m in MARKS)
            stop = next((cut + len(m) for cut, m in cuts if cut > low), stop)
        if piece := body[at:stop].strip():
            out.append((len(out), at, stop, piece))
        if stop >= len(body):
            break
        at = stop - overlap
    return out


def chunks(text: Column | str) -> Column:
    """Array of (position, start, end, text)"""
    pieces = lambda t: [{"position": p, "start": a, "end": b, "text": x} for p, a, b, x in chunk_spans(t)]
    return mapped(pieces, "array<struct<position:int,start:int,end:int,text:string>>")(text)


def locator(position: Column, start: Column, end: Column) -> Column:
    return F.format_string("chunk:%d#%d-%d", position, start, end)
