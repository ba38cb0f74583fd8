"""Exact token counts, with overlap resynchronisation for huge documents.

A document over `whole_chars` is never encoded at once. It is cut into chunks that overlap; each is encoded with offsets.
Two neighbours are spliced at a boundary between pre-tokens that both encodings have in the overlap, kept away from the
chunks' ends by `MARGIN` characters. Such a boundary is stable: the pre-token pattern never looks back, so what follows a
pre-token boundary depends on the text after it alone, and it looks ahead by fewer than MARGIN characters. Merges do not
cross pre-tokens. If the overlap has no such boundary, it is widened, at last to the whole rest.

A tokenizer without pre-tokens (kind .model) has no boundary that is proven this way; it is given whole texts.
"""

import os
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from ._text import has_columns, map_columns

#: Longer than the pattern's lookahead and than any special string that the tokenizer would match first.
MARGIN = 64
#: A batch holds so many characters at most, or one document.
BATCH_CHARS = 400_000


@lru_cache(maxsize=2)
def _loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _boundaries(encoding, base: int) -> dict[int, int]:
    """Text position -> tokens before it, at each start of a pre-token or added token of the chunk at `base`."""
    words, offsets = encoding.word_ids, encoding.offsets
    out, before = {}, object()
    for i, (w, (start, _)) in enumerate(zip(words, offsets)):
        if w != before or w is None:
            out[base + start] = i
        before = w
    return out


def spliced(tokenizer, text: str, chunk: int, overlap: int) -> Iterator[tuple[dict[int, int], int]]:
    """Of a text of any length, chunk by chunk: the boundaries (position -> tokens before it, of the whole text) up to the
    next splice, and how many tokens there are up to it. Together they are those of the whole text at once."""
    total, at = 0, 0  # all before `at` is told, and `at` is a stable boundary
    end = min(chunk, len(text))
    encoding = tokenizer.encode(text[at:end], add_special_tokens=False)
    marks, count = _boundaries(encoding, at), len(encoding.ids)
    while end < len(text):
        wide = overlap
        while True:
            start = max(at, end - wide)
            stop = min(len(text), start + max(chunk, 2 * wide))
            following = tokenizer.encode(text[start:stop], add_special_tokens=False)
            then = _boundaries(following, start)
            common = [p for p in then if p in marks and p <= end - MARGIN and (p >= start + MARGIN or start == at)]
            if common or start == at:
                break
            wide *= 2  # no common boundary: widen
        p = max(common) if common else at
        known = marks[p] if p in marks else 0
        yield {q: total + n for q, n in marks.items() if q < p}, total + known
        total += known
        skipped = then.get(p, 0)
        marks, count = {q: n - skipped for q, n in then.items() if q >= p}, len(following.ids) - skipped
        at, end = p, stop
    yield {q: total + n for q, n in marks.items()}, total + count


def count_long(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text of any length, the same as of the whole text at once."""
    if len(text) <= chunk:
        return len(tokenizer.encode(text, add_special_tokens=False).ids)
    n = 0
    for _, n in spliced(tokenizer, text, chunk, overlap):
        pass
    return n


class Tokens:
    """A tokenizer file's counts and boundaries of whole texts; loaded where it is used, once a process."""

    def __init__(self, vocabulary: str, whole_chars: int = 100_000, overlap: int = 2_000):
        self.vocabulary, self.whole_chars, self.overlap = vocabulary, whole_chars, overlap
        self.plain = vocabulary.endswith(".model")  # a tokenizer without pre-tokens

    def counts(self, texts: list[bytes]) -> list[int]:
        tokenizer = _loaded(self.vocabulary)
        n = [0] * len(texts)
        held: list[int] = []
        size = 0

        def flush():
            if held:
                batch = [texts[i].decode() for i in held]
                found = tokenizer.encode(batch, num_threads=1) if self.plain else tokenizer.encode_batch_fast(batch, add_special_tokens=False)
                for i, x in zip(held, found):
                    n[i] = len(x)
                held.clear()

        for i, x in enumerate(texts):
            if len(x) > self.whole_chars and not self.plain:
                n[i] = count_long(tokenizer, x.decode(), self.whole_chars, self.overlap)
                continue
            if size + len(x) > BATCH_CHARS:
                flush()
                size = 0
            held.append(i)
            size += len(x)
        flush()
        return n

    def boundaries(self, text: str) -> tuple[list[int], list[int], int]:
        """Positions of the starts of pre-tokens, in order, the tokens before each, and all tokens. Without pre-tokens: the
        start alone."""
        if self.plain:
            return [0], [0], self.counts([text.encode()])[0]
        marks, n = {0: 0}, 0
        for some, n in spliced(_loaded(self.vocabulary), text, self.whole_chars, self.overlap):
            marks |= {p: k for p, k in some.items() if p}
        return list(marks), list(marks.values()), n


def token_counts(documents: DataFrame, vocabulary: str, text: str = "text", id: str = "doc_id", limit: int = 512, whole_chars: int = 100_000, overlap: int = 2_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row a row of documents.

    `vocabulary` is the path of a tokenizer file that every executor has. Null text counts as empty (zero bytes and
    tokens); texts of over `whole_chars` bytes are spliced; repeated rows are counted each; an empty table gives an empty
    result; columns besides id and text are not read, whatever their names. No special tokens are added, nothing is
    truncated or padded.
    """
    tokens = Tokens(vocabulary, whole_chars, overlap)

    def start():
        def step(columns):
            ids, raw = columns
            raw = [x or b"" for x in raw]
            n = tokens.counts(raw)
            return [ids, [len(x) for x in raw], n, [x > limit for x in n]]

        return step

    rows = has_columns(documents, doc_id=(id, "long"), text=(text, "string"))
    return map_columns(rows, start, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
