"""Language identification by a linear-chain conditional random field over words.

Features of a word: itself (lexicon), its prefixes and suffixes of one to four bytes, and all
its byte n-grams of one to three, each hashed into a table of ``2**BITS`` rows of weights, one
for each language. Transitions between neighbouring words' languages are learned too, from
chains spliced of two languages, so code-switched text is labelled word by word by
forward-backward. A text's language is the one with the largest mean posterior over its words,
and that mean is its score.

A chain has ``CHAIN`` words at most: a longer text is several chains, all of which count.
The fit takes a bounded sample of labelled chains (``per_lang`` for each language, those with
the lowest hash; copies of a text count once); prediction reads the text alone. Null text, or text without a letter: ``und``,
score 0. No labelled text at all: every row is ``und``. Repeated ids are judged row by row, and of languages
with the same mean the first by name wins. An empty table gives no rows. Columns besides id, text and ``extra`` aren't
read; ``extra`` ones go along under their names, unless a result has it. A text of any length is worked on in
blocks of ``WORDS`` words; only its bytes and word borders are held whole, at some 12 bytes for each of its bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk

BITS = 17
#: Features of a slice take some 100 bytes for each byte of its distinct words.
SLICE_BYTES = 1 << 20
CHAIN = 192
#: Words whose chains are worked on at once, so a long text takes no more memory than a slice.
WORDS = 1 << 17
PER_LANG = 240
KINDS = {"lexicon": 0x51ED270B7A14AD3F, "prefix": 0x2545F4914F6CDD1D, "suffix": 0x9FB21C651E98DF25, "gram": 0xD1342543DE82EF95}


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # 2**BITS x languages
    transitions: np.ndarray  # languages x languages


def _bucket(h: np.ndarray, kind: str) -> np.ndarray:
    return (tk.mix(h ^ tk.U64(KINDS[kind])) >> tk.U64(64 - BITS)).astype(np.int64)


def features(buf: np.ndarray, s: np.ndarray, e: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of all features of the words at [s, e); ``p`` has their lower-cased bytes by ``eights``."""
    who, what = [np.arange(len(s))], [_bucket(tk.span_hash(p, s, e), "lexicon")]
    size = e - s
    for k in (1, 2, 3, 4):
        ok = np.flatnonzero(size >= k)
        who += [ok, ok]
        what += [_bucket(tk.span_hash(p, s[ok], s[ok] + k), "prefix"), _bucket(tk.span_hash(p, e[ok] - k, e[ok]), "suffix")]
    for k in (1, 2, 3):
        n = np.maximum(size - k + 1, 0)
        w = np.repeat(np.arange(len(s)), n)
        at = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + s[w]
        who.append(w)
        what.append(_bucket(tk.span_hash(p, at, at + k), "gram"))
    return np.concatenate(who), np.concatenate(what)


def emissions(buf: np.ndarray, s: np.ndarray, e: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of scores for each word; each distinct word is scored once."""
    p = tk.eights(buf, tk.LOWER)
    _, one, back = np.unique(tk.span_hash(p, s, e), return_index=True, return_inverse=True)
    who, what = features(buf, s[one], e[one], p)
    out = np.stack([np.bincount(who, weights[what, j], minlength=len(one)) for j in range(weights.shape[1])], 1)
    return out[back]


def chains(doc: np.ndarray, n: int, size: int = CHAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of the chains of each text."""
    zero = tk.first_of(doc, n)
    words = np.diff(zero)
    parts = -(-words // size)
    d = np.repeat(np.arange(n), parts)
    k = np.arange(len(d)) - np.repeat(np.cumsum(parts) - parts, parts)
    return zero[d] + k * size, np.minimum(size, words[d] - k * size), d


def forward_backward(emit: np.ndarray, start: np.ndarray, size: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of all words, the summed posteriors of neighbouring pairs (if asked for) and the log partition, for chains side by side."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    top = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, top + 1), "right")
    shift = emit.max(1, keepdims=True)
    x = np.exp(emit - shift)
    t = np.exp(trans)
    a = np.empty_like(x)
    scale = np.ones(len(x))
    for i in range(top):
        at = start[: active[i]] + i
        v = x[at] if i == 0 else x[at] * (prev[: active[i]] @ t)
        z = v.sum(1)
        scale[at] = z
        prev = v / z[:, None]
        a[at] = prev
    log_z = float(np.log(scale).sum() + shift.sum()) if len(x) else 0.0
    g = a.copy()
    m = np.zeros_like(t)
    b = np.ones((len(start), x.shape[1]))
    for i in range(top - 1, 0, -1):
        k = active[i]
        at = start[:k] + i
        y = x[at] * b[:k] / scale[at][:, None]
        b[:k] = y @ t.T
        if pairs:
            m += (a[at - 1].T @ y) * t
        g[at - 1] = a[at - 1] * b[:k]
    return g, m, log_z


def train(texts: list[str], langs: list[str], rounds: int = 60, rate: float = 0.15, decay: float = 1e-4) -> Model:
    """Conditional likelihood by AdaGrad over whole chains; every second chain is spliced with one of another language."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros((0, 0)))
    y0 = np.array([names.index(x) for x in langs])
    buf = np.frombuffer("\n".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(x.encode()) + 1 for x in texts])
    offs = np.concatenate([[0], np.minimum(ends, len(buf))])
    s, e, d = tk.spans(buf, offs, tk.LETTER)
    if not len(s):
        return Model([], np.zeros((1 << BITS, 0)), np.zeros((0, 0)))
    zero = tk.first_of(d, len(texts))
    p = tk.eights(buf, tk.LOWER)
    _, one, back = np.unique(tk.span_hash(p, s, e), return_index=True, return_inverse=True)
    who, what = features(buf, s[one], e[one], p)
    buckets, col = np.unique(what, return_inverse=True)
    # chains as lists of word numbers: each text, and halves of neighbouring texts (in hash order) put together
    seqs = [np.arange(zero[i], zero[i + 1]) for i in range(len(texts)) if zero[i + 1] > zero[i]]
    mixed = []
    for i, j in zip(range(0, len(seqs) - 1), range(1, len(seqs)), strict=True):
        a, b = seqs[i], seqs[(j * 7 + 3) % len(seqs)]
        mixed.append(np.concatenate([a[: max(1, len(a) // 2)], b[len(b) // 2 :]]))
    seqs += mixed[::2]
    flat = np.concatenate(seqs)
    size = np.array([len(x) for x in seqs])
    start = np.cumsum(size) - size
    truth = y0[d[flat]]
    word = back[flat]
    n, k = len(flat), len(names)
    w, t = np.zeros((len(buckets), k)), np.zeros((k, k))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    first = np.ones(n, bool)
    first[start] = False
    at = np.flatnonzero(first)
    seen_t = np.zeros((k, k))
    np.add.at(seen_t, (truth[at - 1], truth[at]), 1)
    seen = np.zeros((len(one), k))
    np.add.at(seen, (word, truth), 1)
    for _ in range(rounds):
        emit_one = np.stack([np.bincount(who, w[col, j], minlength=len(one)) for j in range(k)], 1)
        post, pair, _z = forward_backward(emit_one[word], start, size, t, True)
        got = np.stack([np.bincount(word, post[:, j], minlength=len(one)) for j in range(k)], 1)
        diff = (seen - got) / n
        grad = np.stack([np.bincount(col, diff[who, j], minlength=len(buckets)) for j in range(k)], 1) - decay * w / 100
        grad_t = (seen_t - pair) / n - decay * t
        gw += grad**2
        gt += grad_t**2
        w += rate * grad / np.sqrt(gw)
        t += rate * grad_t / np.sqrt(gt)
    full = np.zeros((1 << BITS, k))
    full[buckets] = w
    return Model(names, full.astype(np.float32), t)


def _sampler(per_lang: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list] = {}
        known: dict[str, set] = {}
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column(1), SLICE_BYTES):
                langs = b.column(2)[lo:hi].to_pylist()
                lo_langs = set(langs)
                h0 = tk.mix(np.array(b.column(0)[lo:hi].to_pylist(), np.int64).view(np.uint64))
                s, e, d = tk.spans(buf, offs, tk.LETTER)
                first, size, text = chains(d, hi - lo)
                nth = np.arange(len(text)) - np.searchsorted(text, text)  # of its text
                key = tk.mix(h0[text] + tk.U64(977) * nth.astype(np.uint64))
                for i in np.argsort(key, kind="stable"):
                    k, v = langs[text[i]], -int(key[i] >> tk.U64(1))
                    mine, here = best.setdefault(k, []), known.setdefault(k, set())
                    if len(mine) == per_lang and v <= mine[0][0]:
                        if all(len(m) == per_lang and v <= m[0][0] for m in best.values()) and lo_langs <= best.keys():
                            break
                        continue
                    if v in here:  # a copy: the same chain of the same text
                        continue
                    here.add(v)
                    item = (v, bytes(buf[s[first[i]] : e[first[i] + size[i] - 1]]).decode(errors="replace"))
                    if len(mine) < per_lang:
                        heapq.heappush(mine, item)
                    else:
                        here.discard(heapq.heapreplace(mine, item)[0])
        rows = [(-v, k, t) for k, mine in best.items() for v, t in mine]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["key", "lang", "text"])

    return run


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None, per_lang: int = PER_LANG) -> Model:
    """A model from the ``per_lang`` chains of each language with the lowest hashes, among all rows that ``where`` keeps."""
    use = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if where is None else where))
    some = use.select(F.xxhash64(text_col).alias("h"), text_col, lang_col).mapInArrow(_sampler(per_lang), "key long, lang string, text string")
    some = some.dropDuplicates(["lang", "key"]).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))).where(F.col("n") <= per_lang)
    rows = some.select("key", "lang", "text").orderBy("key", "lang", "text").collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predictor(held, names_out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.langs, "und"], object)
        k = len(model.langs)
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column(1), SLICE_BYTES):
                n = hi - lo
                s, e, d = tk.spans(buf, offs, tk.LETTER)
                mean = np.zeros((n, k))
                if len(s) and k:
                    first, size, _ = chains(d, n)
                    x = 0
                    while x < len(first):  # blocks of whole chains
                        y = max(x + 1, int(np.searchsorted(first, first[x] + WORDS)))
                        w = slice(int(first[x]), int(first[y - 1] + size[y - 1]))
                        post, _, _ = forward_backward(emissions(buf, s[w], e[w], model.weights), first[x:y] - first[x], size[x:y], model.transitions)
                        mean += np.stack([np.bincount(d[w], post[:, j], minlength=n) for j in range(k)], 1)
                        x = y
                    mean /= np.maximum(np.bincount(d, minlength=n), 1)[:, None]
                best = mean.argmax(1) if k else np.full(n, k)
                lettered = tk.sums(tk.LETTER[buf] & (buf < 128), offs) > 0
                for i in np.flatnonzero(~lettered & (np.diff(offs) > 0)):
                    lettered[i] = any(c.isalpha() for c in bytes(buf[offs[i] : offs[i + 1]]).decode(errors="replace"))
                best = np.where(lettered, best, k)
                score = np.where(best < k, mean[np.arange(n), np.minimum(best, max(k - 1, 0))] if k else 0.0, 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), *(c[lo:hi] for c in b.columns[2:])], names_out)

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, lang_pred, score; from the text alone. ``extra`` columns go along as they are."""
    extra = tuple(c for c in extra if c not in (id_col, "lang_pred", "score"))
    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"x{i}") for i, c in enumerate(extra))]
    names = ["id", "lang_pred", "score", *(f"x{i}" for i in range(len(extra)))]
    kinds = [docs.schema[id_col].dataType.simpleString(), "string", "double", *(docs.schema[c].dataType.simpleString() for c in extra)]
    got = docs.select(*cols).mapInArrow(predictor(docs.sparkSession.sparkContext.broadcast(model), names), ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return got.select(F.col("id").alias(id_col), "lang_pred", "score", *(F.col(f"x{i}").alias(c) for i, c in enumerate(extra)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def label_words(text: str, model: Model) -> list[tuple[str, str]]:
    """Each word of one text with its most probable language."""
    buf = np.frombuffer((text or "").encode(), np.uint8)
    offs = np.array([0, len(buf)])
    s, e, d = tk.spans(buf, offs, tk.LETTER)
    if not len(s) or not model.langs:
        return []
    first, size, _ = chains(d, 1)
    post, _, _ = forward_backward(emissions(buf, s, e, model.weights), first, size, model.transitions)
    return [(bytes(buf[a:b]).decode(errors="replace"), model.langs[i]) for a, b, i in zip(s, e, post.argmax(1), strict=True)]
