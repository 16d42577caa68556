"""Language identification of mixed-language text.

Script ranges first narrow the candidates of a word: only languages whose training text is written in the word's script
remain. Each word gets a score for each candidate from hashed character n-grams (1 to ``MAX_GRAM``). A Viterbi pass over
the words, with a penalty for each change of language, labels the text with spans of one language each. The document's
language is the one with the most letters in its spans; its score is that share of the letters.

Training takes a bounded sample: at most ``TRAIN_DOCUMENTS`` documents of each language, chosen by a hash of their id,
whole texts. Scoring covers every document and the whole of each text. Every lang value of the training rows is learned;
the model takes 256 KB a language, on the driver and in each worker (50 MB for 200 languages), and texts are scored in
blocks that get shorter with the number of languages.

Results for odd input: a null text, or one without a letter, gets ``und`` with score 0 and no spans; ties go to the
first language in code-point order; a text whose script no language of the training data has is scored against all of
them. Without training rows every text is ``und``. Repeated rows get equal results.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkrank.llm.common import bound_batches, ensure_checkpoint_dir, keyed_modulo, map_arrow

UNDETERMINED = "und"
#: Most documents of a language that the model learns from. Every lang value is learned.
TRAIN_DOCUMENTS = 1500
#: Languages whose counts come to the driver at once.
COLLECT_LANGUAGES = 32
#: Longest n-gram, and buckets that n-grams are hashed into.
MAX_GRAM, BUCKETS = 4, 1 << 16
#: Cost in nats of a change of language between two words, and bounds of what a single word can say.
SWITCH_PENALTY, WORD_BOUND = 12.0, 8.0
#: A language uses a script if this share of its letters is written in it.
SCRIPT_SHARE = 0.02
#: Words of a long text that run as one lane of the Viterbi pass.
LANE_WORDS = 256
#: Characters scored at once with up to ``BLOCK_LANGUAGES`` languages, fewer with more; scores looked up at once.
BLOCK_CHARS, BLOCK_LANGUAGES, BLOCK_SCORES = 2_000_000, 8, 16_000_000
#: With more languages than this, lanes of a long text are entered one after the other, without transfer matrices.
MAX_TRANSFER_LANGUAGES = 32


@cache
def script_table() -> tuple[np.ndarray, list[str]]:
    """Script number of every code point (0: no letter; marks belong to any word, 255) and the scripts' names.

    The script is the first word of a letter's Unicode name; CJK and the kana are one script.
    """
    table, names, known = np.zeros(0x110000, np.uint8), [""], {"": 0}
    together = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "IDEOGRAPHIC": "CJK", "FULLWIDTH": "LATIN", "MODIFIER": "LATIN", "FEMININE": "LATIN", "MASCULINE": "LATIN", "MICRO": "GREEK"}
    for point in range(0x110000):
        char = chr(point)
        kind = unicodedata.category(char)
        if kind[0] == "L":
            name = unicodedata.name(char, "CJK").split(" ")[0].split("-")[0]
            name = together.get(name, name)
            if name not in known and len(names) < 250:
                known[name] = len(names)
                names.append(name)
            table[point] = known.get(name, 250)
        elif kind[0] == "M":
            table[point] = 255
    return table, names


def lowered(text: str | None) -> str:
    """The text in lower case, character by character where that keeps its length, so that positions hold in the original."""
    low = (text or "").lower()
    return low if len(low) == len(text or "") else "".join([c.lower() if len(c.lower()) == 1 else c for c in text])


class Words:
    """The words of some texts, as positions in one array of code points."""

    def __init__(self, texts: list[str | None]):
        table, _ = script_table()
        texts = [lowered(t) for t in texts]
        joined = "\n".join(texts) + "\n"
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = table[self.points]
        inside = np.concatenate(([False], kind > 0, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        lengths = np.array([len(t) for t in texts], np.int64)
        text_ends = np.cumsum(lengths + 1)
        self.script = np.zeros(len(starts), np.uint8)
        if len(starts):
            real = np.where(kind == 255, 0, kind)
            # the first letter's script stands for the word
            letter = np.flatnonzero(real)
            at = np.searchsorted(letter, starts)
            has = at < len(letter)
            first = letter[np.minimum(at, max(len(letter) - 1, 0))] if len(letter) else starts
            has &= first < ends
            self.script = np.where(has, real[first], 0).astype(np.uint8)
            starts, ends, self.script = starts[self.script > 0], ends[self.script > 0], self.script[self.script > 0]
        self.starts, self.ends = starts, ends
        self.text = np.searchsorted(text_ends, starts, side="right")
        self.text_starts = text_ends - lengths - 1

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n, the bucket of each n-gram and the word it belongs to. A word is padded by one mark on each side."""
        if not len(self.starts):
            return
        sizes = self.ends - self.starts + 2
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        word = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.arange(offsets[-1]) - offsets[word]
        pad = (inner == 0) | (inner == sizes[word] - 1)
        at = np.where(pad, 0, self.starts[word] + inner - 1)
        chars = np.where(pad, 1, self.points[at]).astype(np.uint32)
        left = sizes[word] - inner
        key = np.zeros(len(chars), np.uint32)
        for n in range(1, MAX_GRAM + 1):
            if n > 1:
                key = key[:-1]
            key = key * np.uint32(0x01000193) ^ chars[n - 1 :] * np.uint32(0x9E3779B1)
            fits = left[: len(key)] >= n
            if n == 1:
                fits &= ~pad
            mixed = key ^ (key >> np.uint32(15)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            mixed = mixed * np.uint32(0x2C1B3C6D)
            yield (mixed >> np.uint32(16))[fits].astype(np.int64), word[: len(key)][fits]


class Model:
    """Log-probabilities of n-gram buckets by language, and the scripts that each language is written in."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: dict[str, dict[str, int]]):
        self.languages = languages
        self.table = np.zeros((BUCKETS, len(languages)), np.float32)
        for i in range(len(languages)):
            smooth = counts[i] + 0.3
            self.table[:, i] = np.log(smooth / smooth.sum())
        _, names = script_table()
        self.allowed = np.zeros((256, len(languages)), bool)
        number = {n: k for k, n in enumerate(names)}
        for i, language in enumerate(languages):
            of = scripts.get(language, {})
            total = sum(of.values())
            for name, n in of.items():
                if n >= SCRIPT_SHARE * total:
                    self.allowed[number.get(name, 250), i] = True
        self.allowed[~self.allowed.any(axis=1)] = True

    def emissions(self, words: Words) -> np.ndarray:
        """Score of each word for each language: mean-free, bounded, far below for languages of other scripts."""
        total = np.zeros((len(words.starts), len(self.languages)), np.float32)
        for bucket, word in words.grams():
            size = max(1, BLOCK_SCORES // len(self.languages))
            for at in range(0, len(bucket), size):
                of = word[at : at + size]
                cut = np.flatnonzero(np.diff(of, prepend=-1))
                total[of[cut]] += np.add.reduceat(self.table[bucket[at : at + size]], cut, axis=0)
        # overlapping n-grams repeat each other's evidence: a word says as much as its n-grams of one length
        total *= (1.0 / MAX_GRAM)
        total -= total.max(axis=1, keepdims=True) if len(total) else 0
        np.maximum(total, -WORD_BOUND, out=total)
        total[~self.allowed[words.script]] = -4 * WORD_BOUND
        return total


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of each word; ``doc`` (ascending) tells where its text is. Exact, and no step count depends on the longest text.

    Texts are cut into lanes of LANE_WORDS words. For a text of several lanes, each lane is first run from every start
    state, which gives its max-plus transfer matrix; the matrices are chained to find the scores at every lane's entry.
    All lanes then run side by side, and are traced back from the last lane of each text to the first.
    """
    n, k = scores.shape
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    lanes_of = -(-counts // LANE_WORDS)
    lane_doc = np.repeat(np.arange(n_docs), lanes_of)
    lane_no = np.arange(len(lane_doc)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    lane_start = first[lane_doc] + lane_no * LANE_WORDS
    lane_len = np.minimum(LANE_WORDS, first[lane_doc] + counts[lane_doc] - lane_start)
    order = np.argsort(-lane_len, kind="stable")
    lane_start, lane_len, lane_doc, lane_no = lane_start[order], lane_len[order], lane_doc[order], lane_no[order]
    active = np.searchsorted(-lane_len, -np.arange(lane_len[0]), side="left")  # lanes longer than t
    entry = np.zeros((len(lane_len), k))
    long = np.flatnonzero((lanes_of[lane_doc] > 1))
    if len(long) and k > MAX_TRANSFER_LANGUAGES:
        for d in np.unique(lane_doc[long]).tolist():
            own = np.flatnonzero(lane_doc == d)
            state = np.zeros(k)
            for i in own[np.argsort(lane_no[own])].tolist():
                entry[i] = state
                for x in scores[lane_start[i] : lane_start[i] + lane_len[i]]:
                    state = np.maximum(state, state.max() - penalty) + x
                state = state - state.max()
    elif len(long):
        transfer = _transfer(scores, lane_start[long], lane_len[long], penalty)
        by_lane = {(int(lane_doc[i]), int(lane_no[i])): j for j, i in enumerate(long)}
        place = {(int(lane_doc[i]), int(lane_no[i])): int(i) for i in long}
        for d in np.unique(lane_doc[long]).tolist():
            state = np.zeros(k)
            for no in range(int(lanes_of[d])):
                entry[place[d, no]] = state
                state = (state[:, None] + transfer[by_lane[d, no]]).max(axis=0)
                state -= state.max()
    steps = int(lane_len[0])
    back = np.zeros((steps, len(lane_len), k), np.int8 if k < 128 else np.int32)
    value = entry.copy()
    for t in range(steps):
        m = active[t]
        v = value[:m]
        best = v.argmax(axis=1)
        top = v[np.arange(m), best][:, None] - penalty
        start_of_text = (lane_no[:m] == 0)[:, None] & (t == 0)
        stay = (v >= top) | start_of_text
        back[t, :m] = np.where(stay, np.arange(k), best[:, None])
        value[:m] = np.where(stay, v, top) + scores[lane_start[:m] + t]
    final = value.argmax(axis=1)
    # lanes of one text are traced last to first; lanes of equal number from the end run together
    from_end = lanes_of[lane_doc] - 1 - lane_no
    carried = np.zeros(n_docs, np.int64)
    for e in range(int(from_end.max()) + 1):
        mine = np.flatnonzero(from_end == e)
        label = final[mine] if e == 0 else carried[lane_doc[mine]]
        own_len = lane_len[mine]
        for t in range(int(own_len.max()) - 1, -1, -1):
            on = own_len > t
            which = mine[on]
            out[lane_start[which] + t] = label[on]
            label[on] = back[t, which, label[on]]
        carried[lane_doc[mine]] = label
    return out


def _transfer(scores: np.ndarray, start: np.ndarray, length: np.ndarray, penalty: float) -> np.ndarray:
    """best[lane, i, j]: best score of a lane that is entered from state i and left in state j."""
    k = scores.shape[1]
    value = np.full((len(start), k, k), -np.inf)
    value[:, np.arange(k), np.arange(k)] = 0.0
    for t in range(int(length.max())):
        on = np.flatnonzero(length > t)
        v = value[on]
        value[on] = np.maximum(v, v.max(axis=2, keepdims=True) - penalty) + scores[start[on] + t][:, None, :]
    return value


def label_texts(texts: list[str | None], model: Model) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) of each text; spans are (first character, end, language) in the text."""
    out = []
    block, size = [], 0
    most = BLOCK_CHARS * BLOCK_LANGUAGES // max(BLOCK_LANGUAGES, len(model.languages))
    for t in [*texts, None]:
        if block and (size + len(t or "") > most or len(block) == len(texts) - len(out)):
            out.extend(_label_block(block, model))
            block, size = [], 0
        block.append(t)
        size += len(t or "")
    return out


def _label_block(texts: list[str | None], model: Model) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    words = Words(texts)
    if not model.languages or not len(words.starts):
        return [(UNDETERMINED, 0.0, [])] * len(texts)
    labels = viterbi(model.emissions(words), words.text, len(texts))
    letters = (words.ends - words.starts).astype(np.float64)
    k = len(model.languages)
    shares = np.bincount(words.text * k + labels, weights=letters, minlength=len(texts) * k).reshape(len(texts), k)
    total, best = shares.sum(axis=1), shares.argmax(axis=1)
    change = np.flatnonzero((np.diff(words.text, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
    stop = np.append(change[1:], len(labels)) - 1
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for a, b in zip(change.tolist(), stop.tolist()):
        d = int(words.text[a])
        base = int(words.text_starts[d])
        spans[d].append((int(words.starts[a]) - base, int(words.ends[b]) - base, model.languages[labels[a]]))
    return [(model.languages[best[i]], float(shares[i, best[i]] / total[i]), spans[i]) if total[i] else (UNDETERMINED, 0.0, []) for i in range(len(texts))]


def train(rows: DataFrame) -> Model:
    """Learn from the (doc_id, text, lang) of ``rows``, whose lang and text are not null.

    The counts of the sample are summed by language and bucket on the executors; the driver gets BUCKETS sums a language at most.
    """
    seen = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages = sorted(r["lang"] for r in seen)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), {})
    # a hash below this share of its range keeps about twice the sample; the rank then makes it exact
    share = F.create_map(*[x for r in seen for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * TRAIN_DOCUMENTS / r["n"] + 50.0 / r["n"])))])
    place = (F.crc32(F.concat(F.lit("sample"), F.col("doc_id").cast("string")).cast("binary")) / F.lit(2.0**32)).alias("place")
    sample = rows.select("doc_id", "text", "lang", place).where(F.col("place") < share[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    sample = sample.withColumn("r", rank).where(F.col("r") <= TRAIN_DOCUMENTS).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        scripts: dict[tuple[str, str], int] = {}
        names = script_table()[1]
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, text in zip(langs, texts):
                words = Words([text])
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for bucket, _ in words.grams():
                    own += np.bincount(bucket, minlength=BUCKETS)
                for s, n in zip(*np.unique(words.script, return_counts=True)):
                    key = (lang, names[s] if s < len(names) else "")
                    scripts[key] = scripts.get(key, 0) + int(n)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array([str(b) for b in at.tolist()], pa.string()), pa.array(own[at], pa.int64())], ["lang", "key", "n"])
        if scripts:
            yield pa.record_batch([pa.array([k[0] for k in scripts], pa.string()), pa.array(["script " + k[1] for k in scripts], pa.string()), pa.array(list(scripts.values()), pa.int64())], ["lang", "key", "n"])

    ensure_checkpoint_dir(rows.sparkSession)
    bound_batches(rows.sparkSession)
    sums = sample.mapInArrow(count, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).checkpoint()
    counts, scripts = np.zeros((len(languages), BUCKETS)), {}
    at = {lang: i for i, lang in enumerate(languages)}
    for i in range(0, len(languages), COLLECT_LANGUAGES):
        table = sums.where(F.col("lang").isin(languages[i : i + COLLECT_LANGUAGES])).toArrow()
        for lang, key, n in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), table.column(2).to_pylist()):
            if key.startswith("script "):
                scripts.setdefault(lang, {})[key[7:]] = n
            else:
                counts[at[lang], int(key)] = n
    return Model(languages, counts, scripts)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (keyed_modulo("doc_id", 4) != 2)).select("doc_id", "text", "lang")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; the text is all that a prediction reads."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def build():
        own = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = label_texts(batch.column(1).to_pylist(), own)
            spans = [[{"start": a, "end": b, "lang": x} for a, b, x in s] for _, _, s in got]
            return pa.record_batch([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

        return apply

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), build, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>", rows=2000)
