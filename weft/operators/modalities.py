"""Modality encoders, page layout, word reconstruction and small array forms (UDF1-UDF3, SEQ7, SEQ19, SEQ22, SEQ23, SRC12, ARR2, STM8, SNK5, SNK8)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.functions.numeric import bind
from weft.functions.text import bigrams
from weft.operators.sequences import collapse
from weft.operators.validation import first_failure
from weft.sources.manifests import require

Encoder = Callable[[Column], Column]
#: Registered encoders: text column to array<array<int>> (steps x codebooks).
ENCODERS: dict[str, Encoder] = {}
CHUNK_WORDS = {"text": 10, "speech": 6}  # fixed values of the demonstration's chunks


def encoder(name: str) -> Callable[[Encoder], Encoder]:
    """Register an encoder: native expressions or a pandas UDF."""

    def add(f: Encoder) -> Encoder:
        ENCODERS[name] = f
        return f

    return add


@encoder("characters")
def characters(text: Column) -> Column:
    """Code points, one codebook."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.array(F.ascii(c)))


@encoder("bytes")
def utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes, one codebook."""
    digits = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)), F.lit(2)), lambda i: i <= F.length(digits)), lambda i: F.array(F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int")))


@dataclass(frozen=True)
class SpeechTokenizer:
    """What a speech tokenizer offers (UDF2), given the frames that its model made: array<array<int>>, one entry a codebook.

    A boundary frame closes the units; collapsing merges runs of equal frames."""

    extractor: str
    vocab: int
    codebooks: int
    sample_rate: int
    collapsed: bool
    end: int
    pad: int

    def __post_init__(self) -> None:
        if self.vocab < 1 or self.codebooks < 1 or max(self.end, self.pad) > 32767:
            raise ValueError("a vocabulary and a codebook are needed, and ids that fit 16 bits")

    def metadata(self) -> dict[str, int | str | bool]:
        return {"unit_extractor": self.extractor, "sample_rate": self.sample_rate, "collapsed": self.collapsed, "vocab_size": self.vocab, "n_codebooks": self.codebooks, "eos_token": self.end, "pad_token": self.pad}

    def frames_problem(self, frames: Column) -> Column:
        """Why frames cannot be encoded; null where they can."""
        return first_failure(
            ("no frames", F.size(frames) > 0),
            ("invalid code shape", F.forall(frames, lambda f: F.size(f) == self.codebooks)),
            ("codes outside the vocabulary", F.forall(F.flatten(frames), lambda x: (x >= 0) & (x < self.vocab))),
        )

    def encode_with_mapping(self, frames: Column) -> Column:
        """struct(codes, frame_to_code)."""
        boundary = F.array_repeat(F.lit(self.end), self.codebooks)
        if self.collapsed:
            return collapse(frames, boundary)
        return bind(F.concat(frames, F.array(boundary)), lambda c: F.struct(c.alias("codes"), F.transform(c, lambda _, i: i).alias("frame_to_code")))

    def encode(self, frames: Column) -> Column:
        return self.encode_with_mapping(frames)["codes"]


#: The vocabulary, codebooks and rates of the two kinds of tokenizers.
SPEECH_TOKENIZERS: dict[str, Callable[..., SpeechTokenizer]] = {
    "hubert": lambda vocab, codebooks=1: SpeechTokenizer("hubert-kmeans", vocab, codebooks, 16000, True, vocab, vocab + 1),
    "mimi": lambda: SpeechTokenizer("mimi", 2048, 8, 24000, False, 2048, 2048),
}


def build_speech_tokenizer(kind: str, **settings: int) -> SpeechTokenizer:
    """The tokenizer of that kind; another one is registered by name."""
    if kind not in SPEECH_TOKENIZERS:
        raise ValueError(f"unknown speech tokenizer {kind}; known: {sorted(SPEECH_TOKENIZERS)}")
    return SPEECH_TOKENIZERS[kind](**settings)


def encode(df: DataFrame, text: str, name: str, out: str = "codes") -> DataFrame:
    """Encode each distinct text once and join back (STM8)."""
    return memoized(df, text, lambda d: d.withColumn(out, ENCODERS[name](F.col(text))))


def memoized(df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """compute() on the distinct keys only, joined back; a null key has null results."""
    return df.join(compute(df.select(key).where(F.col(key).isNotNull()).distinct()), key, "left")


def mono_segment(samples: Column, rate: Column, offset: Column, seconds: Column) -> Column:
    """A segment of frames x channels as the mean over channels; places are rounded half to even."""
    start = F.rint(offset * rate).cast("int")
    length = F.when(seconds.isNull(), F.size(samples)).otherwise(F.rint(seconds * rate).cast("int"))
    return F.transform(F.slice(samples, start + 1, length), lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(c))


def image_patches(pixels: Column, patch: int) -> Column:
    """patch rows of T x patch pixels to T vectors of patch x patch, row by row."""
    width = F.floor(F.size(F.try_element_at(pixels, F.lit(1))) / patch).cast("int")
    one = lambda t: F.flatten(F.transform(pixels, lambda row: F.slice(row, t * patch + 1, F.lit(patch))))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), one)).otherwise(F.array().cast("array<array<int>>"))


def evaluator_spans(words: Column, steps: Column, frames: Column, seconds: Column, runs: Column) -> Column:
    """SEQ7: [start, end) in collapsed steps of each word (text, start, end); invalid and late words drop out.

    runs: the run of each frame; the last step is kept for the end."""

    def reach(w: Column) -> Column:
        first = F.greatest(F.lit(0), F.least(frames - 1, F.floor(w["start"] / seconds * frames).cast("int")))
        last = F.greatest(F.lit(1), F.least(frames, F.ceil(w["end"] / seconds * frames).cast("int")))
        high = F.least(F.get(runs, last - 1) + 1, steps - 1)
        return F.struct(w["text"].alias("text"), F.get(runs, first).alias("start"), high.alias("end"), (last > first).alias("ok"))

    usable = F.filter(words, lambda w: (w["start"] >= 0) & (w["start"] < w["end"]) & (w["end"] <= seconds + 1e-3))
    kept = F.filter(F.transform(usable, reach), lambda s: s["ok"] & (s["start"] < steps - 1) & (s["end"] > s["start"]))
    return F.transform(kept, lambda s: F.struct(s["text"], s["start"], s["end"]))


def page_layout(words: Column, width: Callable[[Column], Column], max_patches: int, patch: int = 16, tail: int = 2) -> Column:
    """SEQ19: starts of words and the length of a page: struct(starts, words, length).

    Each bigram begins on a patch and takes its width rounded up; the text's last one gets `tail` pixels more. Words
    that begin beyond the page are cut; the last patch is the end."""
    patches = F.transform(words, lambda w, i: F.aggregate(F.transform(bigrams(w), lambda b, k: F.ceil((width(b) + F.when((i == F.size(words) - 1) & (k == F.size(bigrams(w)) - 1), tail).otherwise(0)) / patch).cast("int")), F.lit(0), lambda a, x: a + x))
    start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("at"))
    placed = F.aggregate(patches, start, lambda s, n: F.struct(F.concat(s["starts"], F.array(s["at"] + n)).alias("starts"), (s["at"] + n).alias("at")))

    def page(p: Column) -> Column:
        fit = F.size(F.filter(p["starts"], lambda x: x < max_patches - 1))
        kept = F.least(F.size(words), fit)
        end = F.least(F.get(p["starts"], kept), F.lit(max_patches - 1))
        return F.struct(F.slice(p["starts"], 1, kept + 1).alias("starts"), F.slice(words, 1, kept).alias("words"), (end + 1).alias("length"))

    return bind(placed, page)


def text_prompt(ids: Column, image_pad: int, image_books: int, audio_pad: int, audio_books: int) -> Column:
    """SEQ22: rows of a text prompt: the token, then padding of the other modalities."""
    return F.transform(ids, lambda t: F.concat(F.array(t), F.array_repeat(F.lit(image_pad), image_books), F.array_repeat(F.lit(audio_pad), audio_books)))


def generated_codes(output: Column, prompt_length: Column, first_audio: int) -> Column:
    """The audio columns after the prompt and its switch."""
    return F.transform(F.slice(output, prompt_length + 2, F.greatest(F.size(output) - prompt_length - 1, F.lit(0))), lambda row: F.slice(row, first_audio + 1, F.greatest(F.size(row) - first_audio, F.lit(0))))


def words_of_runs(runs: DataFrame, keys: list[str], end_of_word: int, silent: list[int]) -> DataFrame:
    """SEQ23: words (keys, word, tokens, start, end) of runs (place, token, duration): up to and with each end of word."""
    by = Window.partitionBy(*keys).orderBy("place")
    marked = runs.withColumn("end", F.sum("duration").over(by)).withColumn("mark", (F.col("token") == end_of_word).cast("int"))
    marked = marked.withColumn("word", (F.sum("mark").over(by) - F.col("mark")).cast("long"))
    spoken = F.filter(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: (x["token"] != end_of_word) & ~x["token"].isin(*silent))
    words = marked.groupBy(*keys, "word").agg(F.transform(spoken, lambda x: x["token"]).alias("tokens"), F.min(F.col("end") - F.col("duration")).alias("start"), F.max("end").alias("end"), F.max("mark").alias("closed"))
    return words.where("closed = 1 and size(tokens) > 0").select(*keys, "word", "tokens", "start", "end")


def chunk_labels(words: DataFrame, keys: list[str]) -> DataFrame:
    """Alternating chunks of ten text and six speech words: keys, chunk, modality, and positions it takes (a switch before each but the first)."""
    cycle = sum(CHUNK_WORDS.values())
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("word")) - 1
    text = CHUNK_WORDS["text"]
    placed = words.withColumn("__at", at)
    placed = placed.withColumn("chunk", (F.floor(F.col("__at") / cycle) * 2 + (F.col("__at") % cycle >= text).cast("int")).cast("long"))
    spoken = F.max("end") - F.min("start")
    grouped = placed.groupBy(*keys, "chunk").agg(F.sum(F.size("tokens")).alias("tokens"), spoken.alias("frames"))
    is_text = F.col("chunk") % 2 == 0
    return grouped.select(*keys, "chunk", F.when(is_text, "text").otherwise("speech").alias("modality"), (F.when(is_text, F.col("tokens")).otherwise(F.col("frames")) + (F.col("chunk") > 0).cast("int")).cast("long").alias("positions"))


def add_metadata(table: DataFrame, entries: DataFrame) -> DataFrame:
    """First writer wins: entries (name, content) that are new are added; a different content for a name raises an error."""
    every = table.select("name", "content").unionByName(entries.select("name", "content"))
    told = every.groupBy("name").agg(F.min("content").alias("content"), F.max("content").alias("__other"))
    return require(told, F.col("content") == F.col("__other"), F.concat(F.lit("metadata conflict at "), F.col("name"))).drop("__other")


def merge_parts(old: Column, new: Column) -> Column:
    """Sorted distinct part names."""
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), new)))
