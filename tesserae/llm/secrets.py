"""Secret scan by a linear-chain conditional random field.

A text is cut into tokens over its UTF-8 bytes: runs of letters, digits and underscores, and single marks. The field tags
every token as secret begin, inside or outside from its shape, the words around it and features of the file, with weights
for tags that follow each other; Viterbi decoding gives the best tagging.

Training is done on the driver, on a bounded sample of documents (``max_train``, a documented parameter) cut to windows:
secrets made by a generator are planted at known places beside look-alikes that are none, and secrets of the same formats
that the sample has already are tagged too, so no labels are needed.

Scoring is one pass without a shuffle, in numpy over the bytes of a batch. A token whose score for "outside" beats the
others by more than all tags around it could ever make up is outside in every best tagging. Almost all tokens are; the
chains between them are short and are decoded one by one, which gives the same tags as decoding whole texts.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, q

TAGS = ("outside", "begin", "inside")
BUCKETS, SHAPES = 4096, 4096
#: Weight tables by token offset: words two before to one after, shapes one before to one after.
WORD_AT, SHAPE_AT = (-2, -1, 0, 1), (-1, 0, 1)
FILES = 16
WINDOW = 48

_kind = np.full(256, 4, np.uint8)  # 0 space, 1 digit, 2 lower, 3 upper, 4 mark, 5 other letters (bytes of UTF-8 sequences)
_kind[[9, 10, 11, 12, 13, 32]] = 0
_kind[[ord(c) for c in string.digits]] = 1
_kind[[ord(c) for c in string.ascii_lowercase + "_"]] = 2
_kind[[ord(c) for c in string.ascii_uppercase]] = 3
_kind[128:] = 5
_hexlike = np.zeros(256, np.uint8)
_hexlike[[ord(c) for c in "0123456789abcdefABCDEF"]] = 1
_fold = np.arange(256, dtype=np.uint64)
_fold[65:91] += 32
_B = np.uint64(0x9E3779B97F4A7C15 | 1)


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the tokens of a byte array."""
    k = _kind[data]
    wordy = (k != 0) & (k != 4)
    mark = k == 4
    before = np.concatenate([[False], wordy[:-1]])
    after = np.concatenate([wordy[1:], [False]])
    starts = np.flatnonzero((wordy & ~before) | mark)
    ends = np.flatnonzero((wordy & ~after) | mark) + 1
    return starts, ends


def describe(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word bucket, shape) of every token. A shape packs the length, the shares of digits and capitals, changes between
    kinds of characters, and whether all characters are hexadecimal; of a mark it is the mark itself."""
    n = len(starts)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    k = _kind[data]

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(values, dtype=np.int32, out=sums[1:])
        return sums[ends] - sums[starts]

    length = ends - starts
    digits, upper, hexes, foreign = total(k == 1), total(k == 3), total(_hexlike[data]), total(k == 5)
    change = np.zeros(len(data), bool)
    change[1:] = k[1:] != k[:-1]
    changes = total(change) - change[starts]
    size = np.searchsorted([2, 4, 6, 9, 12, 16, 20, 24, 32, 44, 64], length, side="right")  # 0 to 11
    digit_share = np.where(digits == 0, 0, 1 + (3 * digits) // np.maximum(length, 1))  # 0 to 4
    upper_share = np.where(upper == 0, 0, np.where(upper == length, 3, np.where((upper == 1) & (k[starts] == 3), 1, 2)))
    turn = np.searchsorted([1, 3, 6], changes, side="right")  # 0 to 3
    shape = (((size * 5 + digit_share) * 4 + upper_share) * 4 + turn) * 2 + (hexes == length)
    shape = np.where(foreign > 0, 12 * 160 + size, shape)
    first = data[starts]
    shape = np.where(k[starts] == 4, 2048 + first.astype(np.int64), shape).astype(np.int32)
    # hash of the folded bytes: a sum of byte * B**place, made independent of the place by the inverse power
    power = _powers(len(data), _B)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_fold[data] + np.uint64(1)) * power, out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _powers(len(data), np.uint64(pow(int(_B), -1, 1 << 64)))[starts]
    return (mix64(raw) % np.uint64(BUCKETS)).astype(np.int32), shape


_tables: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    table = _tables.get(int(base), np.ones(1, np.uint64))
    while len(table) < n:
        table = np.concatenate([table, table * np.uint64(pow(int(base), len(table), 1 << 64))])
    _tables[int(base)] = table
    return table[:n]


def file_feature(data: np.ndarray) -> int:
    """Bucket of a whole text: its shares of digits and of marks."""
    if not len(data):
        return 0
    k = np.bincount(_kind[data], minlength=6) / len(data)
    return int(np.searchsorted([0.005, 0.02, 0.08], k[1])) * 4 + int(np.searchsorted([0.02, 0.06, 0.15], k[4]))


def around(values: np.ndarray, offset: int, none: int, doc: np.ndarray) -> np.ndarray:
    """Value of the token ``offset`` places on, ``none`` beyond the ends of a text."""
    out = np.full(len(values), none, np.int32)
    if not len(values) or abs(offset) >= len(values):
        return out if offset else values
    if offset < 0:
        same = doc[-offset:] == doc[:offset]
        out[-offset:] = np.where(same, values[:offset], none)
    elif offset > 0:
        same = doc[offset:] == doc[:-offset]
        out[:-offset] = np.where(same, values[offset:], none)
    else:
        out = values
    return out


@dataclass
class Field:
    words: np.ndarray  # [len(WORD_AT), BUCKETS + 1, 3]
    shapes: np.ndarray  # [len(SHAPE_AT), SHAPES + 1, 3]
    files: np.ndarray  # [FILES, 3]
    follow: np.ndarray  # [3, 3], from the tag before
    start: np.ndarray  # [3]

    def scores(self, word: np.ndarray, shape: np.ndarray, file: np.ndarray, doc: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
        """[tokens, 3], of all tokens or those at ``only``."""
        at = slice(None) if only is None else only
        out = self.files[file[at]].astype(np.float64)
        for table, o in zip(self.words, WORD_AT):
            out += table[around(word, o, BUCKETS, doc)[at]]
        for table, o in zip(self.shapes, SHAPE_AT):
            out += table[around(shape, o, SHAPES, doc)[at]]
        return out

    def __post_init__(self):
        self.bounds = None

    def doubtful(self, word: np.ndarray, shape: np.ndarray, file: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Tokens that could be other than outside if the most that each feature and any neighbouring tags say is added."""
        if self.bounds is None:  # single numbers, so that a feature is one lookup
            self.bounds = [[(t[..., 1:] - t[..., :1]).max(axis=-1).astype(np.float32) for t in part] for part in (self.words, self.shapes, [self.files])]
        words, shapes, files = self.bounds
        out = files[0][file]
        for table, o in zip(words, WORD_AT):
            out += table[around(word, o, BUCKETS, doc)]
        for table, o in zip(shapes, SHAPE_AT):
            out += table[around(shape, o, SHAPES, doc)]
        return np.flatnonzero(out >= -float(self.before().max() + self.after().max()) - 1e-3)

    def before(self) -> np.ndarray:
        """By begin and inside: the most that the tag before can speak for it against outside."""
        return np.maximum((self.follow[:, 1:] - self.follow[:, :1]).max(axis=0), self.start[1:] - self.start[0])

    def after(self) -> np.ndarray:
        return np.maximum((self.follow[1:] - self.follow[:1]).max(axis=1), 0.0)

    def open_tokens(self, at: np.ndarray, scores: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which of the tokens ``at`` some best tagging may tag other than outside. Each round knows more outside neighbours."""
        n, f = len(doc), self.follow
        gain = scores[:, 1:] - scores[:, :1]
        first, last = (at == 0) | (doc[at - 1] != doc[at]), (at == n - 1) | (doc[np.minimum(at + 1, n - 1)] != doc[at])
        keep = np.arange(len(at))
        for _ in range(8):  # what isn't settled then is decoded
            a = at[keep]
            step = np.diff(a) == 1
            left = np.concatenate([[False], step])[:, None]
            right = np.concatenate([step, [False]])[:, None]
            before = np.where(first[keep, None], self.start[1:] - self.start[0], np.where(left, self.before(), f[0, 1:] - f[0, 0]))
            after = np.where(last[keep, None], 0.0, np.where(right, self.after(), f[1:, 0] - f[0, 0]))
            stay = (gain[keep] + before + after >= 0).any(axis=1)
            if stay.all():
                return keep
            keep = keep[stay]
            if not len(keep):
                break
        return keep

    def viterbi(self, scores: np.ndarray, first: bool, last: bool) -> list[int]:
        """Best tags of one chain that stands between outside tokens, or at the start (``first``) or end of a text."""
        best = (self.start if first else self.follow[0]) + scores[0]
        back = []
        for row in scores[1:]:
            step = best[:, None] + self.follow
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        tag = int((best if last else best + self.follow[:, 0]).argmax())
        out = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            out.append(tag)
        return out[::-1]


def found(field: Field, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, start, end) in bytes of the secrets in texts that lie end to end in ``data``, each in ``bounds[i:i+2]``."""
    starts, ends = tokens(data)
    if not len(starts):
        return []
    doc = np.searchsorted(bounds, starts, side="right").astype(np.int32) - 1
    word, shape = describe(data, starts, ends)
    files = np.array([file_feature(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], np.int32)
    maybe = field.doubtful(word, shape, files[doc], doc)
    if not len(maybe):
        return []
    scores = field.scores(word, shape, files[doc], doc, maybe)
    keep = field.open_tokens(maybe, scores, doc)
    maybe, scores = maybe[keep], scores[keep]
    if not len(maybe):
        return []
    new = np.concatenate([[True], (np.diff(maybe) > 1) | (np.diff(doc[maybe]) > 0)])
    firsts = np.flatnonzero(new)
    out = []
    for a, b in zip(firsts, np.append(firsts[1:], len(maybe))):
        i, j = maybe[a], maybe[b - 1]
        tags = field.viterbi(scores[a:b], i == 0 or doc[i - 1] != doc[i], j + 1 == len(doc) or doc[j + 1] != doc[j])
        open_at = None
        for t, tag in zip(range(i, j + 1), tags):
            if tag == 1 or (tag == 2 and open_at is None):
                if open_at is not None:
                    out.append((int(doc[i]), int(starts[open_at]), int(ends[t - 1])))
                open_at = t
            elif tag == 0 and open_at is not None:
                out.append((int(doc[i]), int(starts[open_at]), int(ends[t - 1])))
                open_at = None
        if open_at is not None:
            out.append((int(doc[i]), int(starts[open_at]), int(ends[j])))
    return out


_NAMES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_token", "auth_token", "client_secret", "secret_key", "pwd")
_B64 = string.ascii_letters + string.digits
#: Formats that mark a secret in a text as it is: a group is the secret.
KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,48}|xox[bap]-[0-9A-Za-z-]{20,})(?![A-Za-z0-9])"
    r"|(?i:token|secret|passw(?:or)?d|pwd|api_?key|access_token|auth_token|client_secret|secret_key)\"?\s*[=:]\s*[\"']?([A-Za-z0-9+/_\-]{12,})"
)


def make_secret(rng: np.random.Generator) -> tuple[str, int, int]:
    """A planted text with the range of the secret inside it."""
    pick = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    kind = int(rng.integers(0, 9))
    if kind == 0:
        s = "AKIA" + pick(string.ascii_uppercase + string.digits, 16)
        return s, 0, len(s)
    if kind == 1:
        s = "gh" + pick("pousr", 1) + "_" + pick(_B64, 36)
        return s, 0, len(s)
    if kind == 2:
        s = "sk-" + pick(_B64, int(rng.integers(32, 49)))
        return s, 0, len(s)
    if kind == 3:
        s = "eyJ" + pick(_B64, int(rng.integers(15, 30))) + "." + pick(_B64, int(rng.integers(20, 50))) + "." + pick(_B64 + "-_", int(rng.integers(20, 44)))
        return s, 0, len(s)
    chars, n = [("0123456789abcdef", int(rng.integers(16, 65))), (_B64, int(rng.integers(12, 44))), (_B64 + "+/", 40)][int(rng.integers(0, 3))]
    s = pick(chars, n)
    name = _NAMES[int(rng.integers(0, len(_NAMES)))]
    name = name.upper() if rng.random() < 0.2 else name
    lead, tail = [("{}=", ""), ("{} = \"", "\""), ("{}: ", ""), ("\"{}\": \"", "\""), ("{}='", "'")][int(rng.integers(0, 5))]
    lead = lead.format(name)
    return lead + s + tail, len(lead), len(lead) + len(s)


def make_lookalike(rng: np.random.Generator) -> str:
    """Text that resembles a secret and is none: numbers, addresses, dates, digests, identifiers and plain settings."""
    pick = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    d, x = string.digits, "0123456789abcdef"
    kind = int(rng.integers(0, 12))
    return [
        pick(d, 16), f"{pick(string.ascii_lowercase, 6)}.{pick(d, 2)}@mail{pick(d, 1)}.example.com", ".".join(str(v) for v in rng.integers(1, 255, 4)),
        f"({pick(d, 3)}) {pick(d, 3)}-{pick(d, 4)}", f"commit {pick(x, 40)}", f"sha256:{pick(x, 64)}", f"{pick(x, 8)}-{pick(x, 4)}-{pick(x, 4)}-{pick(x, 4)}-{pick(x, 12)}",
        f"{pick(d, 4)}-{pick(d, 2)}-{pick(d, 2)}", f"http://www.{pick(string.ascii_lowercase, 8)}.org/{pick(_B64, 11)}", f"{pick(string.ascii_uppercase, 3)}-{pick(d, 6)}",
        f"{pick(string.ascii_lowercase, 5)} = \"{pick(string.ascii_lowercase, 9)}\"", f"the {_NAMES[int(rng.integers(0, len(_NAMES)))]} is {pick(string.ascii_lowercase, 7)}",
    ][kind]


def examples(texts: list[str], seed: int, planted: int = 4) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """(bytes, secret ranges in bytes) of each text with secrets and look-alikes planted between its words."""
    rng = np.random.default_rng(seed)
    out = []
    for text in texts:
        gaps = [m.start() for m in re.finditer(r"\s", text)]
        cuts = sorted(rng.choice(gaps, min(len(gaps), 2 * planted), replace=False).tolist()) if gaps else []
        parts, spans, size, last = [], [], 0, 0
        for c in [*cuts, len(text)]:
            piece = text[last:c].encode("utf-8", "surrogatepass")
            spans += [(size + len(text[last : m.start(g)].encode("utf-8", "surrogatepass")), size + len(text[last : m.end(g)].encode("utf-8", "surrogatepass"))) for m in KNOWN.finditer(text, last, c) for g in [1 if m.group(1) else 2]]
            parts.append(piece)
            size += len(piece)
            if c < len(text):
                if rng.random() < 0.5:
                    s, a, b = make_secret(rng)
                    spans.append((size + 1 + a, size + 1 + b))
                else:
                    s = make_lookalike(rng)
                parts.append(f" {s}".encode())
                size += len(s) + 1
            last = c
        out.append((np.frombuffer(b"".join(parts), np.uint8), spans))
    return out


def tags_of(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    tags = np.zeros(len(starts), np.int8)
    for a, b in spans:
        inside = np.flatnonzero((starts >= a) & (ends <= b))
        tags[inside] = 2
        tags[inside[:1]] = 1
    return tags


def fit(made: list[tuple[np.ndarray, list[tuple[int, int]]]], rounds: int = 60, rate: float = 0.35, l2: float = 2e-5, l2_follow: float = 2e-2, seed: int = 3) -> Field:
    """Maximum likelihood by forward-backward over windows of WINDOW tokens, all at once, with Adagrad steps.

    Weights between tags are held small (``l2_follow``): tokens then speak mostly for themselves, and few are in doubt.
    """
    rng = np.random.default_rng(seed)
    word_rows, shape_rows, file_rows, tag_rows, lengths, begins = [], [], [], [], [], []
    for data, spans in made:
        starts, ends = tokens(data)
        if not len(starts):
            continue
        word, shape = describe(data, starts, ends)
        doc, tags = np.zeros(len(starts), np.int32), tags_of(starts, ends, spans)
        words = np.stack([around(word, o, BUCKETS, doc) for o in WORD_AT], 1)
        shapes = np.stack([around(shape, o, SHAPES, doc) for o in SHAPE_AT], 1)
        file, n = file_feature(data), len(starts)
        marked = np.flatnonzero(tags == 1)
        at = {max(0, int(m) - int(rng.integers(4, WINDOW - 8))) for m in marked} | {int(v) for v in rng.integers(0, max(1, n - WINDOW // 2), 3)} | {0}
        for a in sorted(at):
            b = min(n, a + WINDOW)
            pad = ((0, WINDOW - (b - a)), (0, 0))
            word_rows.append(np.pad(words[a:b], pad, constant_values=BUCKETS))
            shape_rows.append(np.pad(shapes[a:b], pad, constant_values=SHAPES))
            tag_rows.append(np.pad(tags[a:b], pad[0]))
            file_rows.append(file)
            lengths.append(b - a)
            begins.append(a == 0)
    field = Field(np.zeros((len(WORD_AT), BUCKETS + 1, 3)), np.zeros((len(SHAPE_AT), SHAPES + 1, 3)), np.zeros((FILES, 3)), np.zeros((3, 3)), np.zeros(3))
    if not lengths:
        field.files[:, 1:] = -20.0
        return field
    words, shapes, tags = np.stack(word_rows), np.stack(shape_rows), np.stack(tag_rows).astype(np.int64)
    files, n, begins = np.array(file_rows), np.array(lengths), np.array(begins)
    live = np.arange(WINDOW)[None, :] < n[:, None]
    rows = len(n)
    onehot = np.eye(3)[tags] * live[:, :, None]
    parts = [field.words, field.shapes, field.files, field.follow, field.start]
    speed = [np.full(p.shape, 1e-3) for p in parts]
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (tags[:, :-1][live[:, 1:]], tags[:, 1:][live[:, 1:]]), 1)

    def scatter(index: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(index.ravel(), values[..., k].ravel(), size) for k in range(3)], 1)

    for _ in range(rounds):
        e = field.files[files][:, None, :] + sum(field.words[i][words[:, :, i]] for i in range(len(WORD_AT))) + sum(field.shapes[i][shapes[:, :, i]] for i in range(len(SHAPE_AT)))
        e = np.where(live[:, :, None], e, 0.0)
        f = np.exp(field.follow)
        alpha, beta, scale = np.zeros((rows, WINDOW, 3)), np.ones((rows, WINDOW, 3)), np.ones((rows, WINDOW))
        p = np.exp(e - e.max(axis=2, keepdims=True))
        a = np.where(begins[:, None], np.exp(field.start)[None, :], np.exp(field.follow[0])[None, :]) * p[:, 0]
        for t in range(WINDOW):
            if t:
                a = np.where(live[:, t, None], (alpha[:, t - 1] @ f) * p[:, t], alpha[:, t - 1])
            scale[:, t] = a.sum(axis=1)
            alpha[:, t] = a / scale[:, t, None]
        for t in range(WINDOW - 2, -1, -1):
            b = (beta[:, t + 1] * p[:, t + 1]) @ f.T / scale[:, t + 1, None]
            beta[:, t] = np.where(live[:, t + 1, None], b, 1.0)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        gamma *= live[:, :, None]
        expected = np.einsum("rti,rtj->ij", alpha[:, :-1] * live[:, 1:, None], beta[:, 1:] * p[:, 1:] / scale[:, 1:, None]) * f
        gap = onehot - gamma
        first = gap[:, 0]
        grads = [
            np.stack([scatter(words[:, :, i], BUCKETS + 1, gap) for i in range(len(WORD_AT))]), np.stack([scatter(shapes[:, :, i], SHAPES + 1, gap) for i in range(len(SHAPE_AT))]),
            scatter(np.repeat(files, WINDOW), FILES, gap.reshape(-1, 3)), pairs - expected, first[begins].sum(axis=0),
        ]
        grads[3][0] += first[~begins].sum(axis=0)
        for x, g, s, shrink in zip(parts, grads, speed, (l2, l2, l2, l2_follow, l2_follow)):
            g = g / rows - shrink * x
            s += g * g
            x += rate * g / np.sqrt(s)
    return field


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = 800, seed: int = 5, **options) -> Field:
    """Fit on at most ``max_train`` documents, those of the smallest seeded hash of the id, with planted secrets."""
    order = F.xxhash64(q(id_col), F.lit(seed))
    chosen = docs.where(q(id_col).isNotNull()).select(order.alias("o"), q(id_col).alias("id")).orderBy("o", "id").limit(max_train).agg(F.max("o")).first()[0]
    if chosen is None:
        return fit([], **options)
    sample = docs.where(q(id_col).isNotNull() & q(text_col).isNotNull() & (order <= chosen)).select(order.alias("o"), q(id_col).alias("id"), q(text_col).alias("text"))
    rows = sample.orderBy("o", "id", F.xxhash64("text")).limit(max_train).collect()
    return fit(examples([r.text for r in rows], seed), **options)


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, secret): one row for every secret that ``field`` finds, in characters of the whole text.

    Every row of ``docs`` is scanned by itself: repeated rows give repeated findings, and a null id is carried as null. A
    null or empty text has none. An empty table gives an empty table. Other columns take no part.
    """
    source = docs.select(q(id_col).alias("id"), q(text_col).alias("text")).where(F.col("text").isNotNull())
    kind = dict(source.dtypes)["id"]

    def tag(parts):
        for b in parts:
            if not b.num_rows:
                continue
            texts = [t.as_py().encode("utf-8", "surrogatepass") for t in b.column("text")]
            hits, at = [], 0
            while at < len(texts):  # groups of bounded bytes, however long single texts are
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 20):
                    size += len(texts[to])
                    to += 1
                bounds = np.cumsum([0] + [len(t) for t in texts[at:to]])
                hits += [(at + d, int(s - bounds[d]), int(e - bounds[d])) for d, s, e in found(field, np.frombuffer(b"".join(texts[at:to]), np.uint8), bounds)]
                at = to
            rows = [h[0] for h in hits]
            starts = [len(texts[d][:s].decode("utf-8", "surrogatepass")) for d, s, _ in hits]
            secrets = [texts[d][s:e].decode("utf-8", "surrogatepass") for d, s, e in hits]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array([s + len(x) for s, x in zip(starts, secrets)], pa.int32()), pa.array(secrets, pa.string())],
                names=["id", "start", "end", "secret"],
            )

    return source.mapInArrow(tag, f"id {kind}, start int, end int, secret string").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
