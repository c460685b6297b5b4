"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A BPE encoding is valid exactly if each pair of neighbouring tokens is what the merges
make of the two together. So the encoding of a prefix is that of a shorter prefix and one
more token, and a table holds for every prefix its last token and its count: one more
than the count before that token. Truncation and budget questions read the table and
never encode again.

The pieces of the vocabulary begin with blanks or hold none, and no piece holds a line
feed; so texts fall into words whose tables are independent, and a prefix of the text is whole
words and a prefix of one. The state at a prefix serves all words that begin with it: new
words are worked out in order, each from where it parts from the one before. Whole words'
counts are kept in a cache; a table is made again for the word that a budget ends in.

Blanks merge with one another at equal scores, after all other merges, so neighbours alone do
not decide there. But then a run of blanks falls into longest pieces from the left: its count
is periodic, and a word after several blanks is a run of blanks and a word after one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibridge.llm.merging import merged

#: Characters of the words whose token counts a worker keeps; words longer than CACHE_LONGEST are not kept.
CACHE_CHARS = 10_000_000
CACHE_LONGEST = 64
CACHE_PAIRS = 1_000_000
WORDS = re.compile(r"\n| +[^ \n]*|[^ \n]+")


class PrefixCounter:
    """Token counts of a sentencepiece BPE model with byte fallback and a blank before the text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i).replace("▁", " "): model.get_score(i) for i in kept}
        if model.normalize("  x ﬁ") != "▁▁▁x▁ﬁ" or any(" " in p.lstrip(" ") or "\n" in p for p in pieces):
            raise ValueError("the model's normaliser or pieces do not let texts fall into words")
        # Merges go by score; equal scores rank alike, and of these the leftmost merges first.
        order = {s: n for n, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.ranks = {p: order[s] for p, s in pieces.items()}
        self.longest = max(map(len, self.ranks))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.totals: dict[str, int] = {}
        self.held, self.passing = 0, []
        blanks = [p for p in self.ranks if p.startswith("  ")]
        self.period = max(map(len, blanks), default=1)
        self.blanks = [len(self.merge(" " * n)) for n in range(4 * self.period)]
        last = max(self.ranks.values())
        if any(p.strip(" ") or self.ranks[p] < last for p in blanks) or any(self.blanks[n] != self.blanks[n - self.period] + 1 for n in range(self.period, len(self.blanks))):
            raise ValueError("the model's pieces of several blanks do not let runs of blanks be counted by themselves")

    def _run(self, n: int) -> int:
        """Tokens of a run of blanks that nothing else merges with."""
        return self.blanks[n % self.period] + n // self.period

    def merge(self, text: str) -> list[str]:
        """The merges themselves; a character without a piece stays alone."""
        return merged(list(text), self.ranks)

    def _valid(self, before: str, token: str) -> bool:
        key = (before, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(before + token) == ([before, token] if before else [token])
        return known

    def _extend(self, word: str, counts: list[int], last: list[str]) -> None:
        """Carry counts and last tokens of the first prefixes of `word` on to all of them."""
        ranks, pairs = self.ranks, self.pairs
        for i in range(len(counts), len(word) + 1):
            if word[i - 1] not in ranks:
                counts.append(counts[-1] + len(word[i - 1].encode()))
                last.append("")
                continue
            # Mostly the longest piece that ends here is the one; exactly one is valid.
            for j in range(max(i - self.longest, 0), i):
                token = word[j:i]
                if token in ranks and (pairs[known] if (known := (last[j], token)) in pairs else self._valid(*known)):
                    counts.append(counts[j] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError(f"no encoding ends at {i} of {word!r}")

    def _after_blanks(self, blanks: int, counts: list[int], last: list[str]) -> list[int]:
        """Counts of the non-empty prefixes of a word after so many blanks more, from its own states.

        Where the word's first blank is a token by itself, it belongs to the run.
        """
        alone = [False]
        for i, token in enumerate(last[1:], 1):
            alone.append(token == " " if i == len(token) else alone[i - (len(token) or 1)])
        joined, apart = self._run(blanks + 1) - 1, self._run(blanks)
        return [n + (joined if a else apart) for n, a in zip(counts[1:], alone[1:], strict=True)]

    def table(self, word: str) -> list[int]:
        """Token counts of all prefixes of a word, from the empty one on."""
        blanks = max(len(word) - len(word.lstrip(" ")) - 1, 0)
        counts, last = [0], [""]
        self._extend(word[blanks:], counts, last)
        return [*map(self._run, range(blanks + 1)), *self._after_blanks(blanks, counts, last)] if blanks else counts

    def _words(self, text: str) -> list[str]:
        return WORDS.findall(" " + text.replace("▁", " ")) if text else []

    def _learn(self, words: set[str]) -> None:
        for w in self.passing:
            self.totals.pop(w, None)
        new = words.difference(self.totals)
        if self.held > CACHE_CHARS:
            self.totals.clear()
            self.held, new = 0, words
        # Words after several blanks share the states of the word after one.
        deep: dict[str, list[str]] = {}
        for w in new:
            if w.startswith("  "):
                deep.setdefault(" " + w.lstrip(" "), []).append(w)
        counts, last, before = [0], [""], ""
        for w in sorted({w for w in new if not w.startswith("  ")} | deep.keys()):
            same = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                same += 1
            del counts[same + 1 :], last[same + 1 :]
            self._extend(w, counts, last)
            self.totals[w], before = counts[-1], w
            for longer in deep.get(w, ()):
                self.totals[longer] = self._after_blanks(len(longer) - len(w), counts, last)[-1]
        self.passing = [w for w in new | deep.keys() if len(w) > CACHE_LONGEST]
        self.held += sum(map(len, new)) - sum(map(len, self.passing))

    def count(self, texts: list[str], budget: int) -> tuple[list[int], list[int]]:
        """Of every text: its tokens, and the characters of its longest prefix of at most `budget` tokens."""
        words = [self._words(t) for t in texts]
        self._learn({w for ws in words for w in ws})
        totals = [sum(map(self.totals.__getitem__, ws)) for ws in words]
        return totals, [len(t) if n <= budget else self._cut(ws, budget) for t, ws, n in zip(texts, words, totals, strict=True)]

    def _cut(self, words: list[str], budget: int) -> int:
        best = chars = spent = 0
        for w in words:
            # No piece is longer than `longest`, so counts of longer prefixes cannot fall below this again.
            if spent > budget:
                break
            # A prefix has no more tokens than bytes.
            inside = len(w) if spent + 4 * len(w) <= budget else max((i for i, n in enumerate(self.table(w)) if spent + n <= budget), default=0)
            best = max(best, chars + inside)
            chars, spent = chars + len(w), spent + self.totals[w]
        return max(best - 1, 0)  # without the blank before the text


@cache
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, kept_chars) of every whole text.

    kept_chars: characters of the longest prefix of at most `limit` tokens. A null text counts
    as empty: no bytes, no tokens. Reads doc_id and text alone; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lexibridge.llm.arrays import slices

        counter = _counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, stop in slices([len(t) for t in texts]):
                totals, kept = counter.count(texts[start:stop], limit)
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(start, stop - start), "n_bytes": batch.column("n_bytes").slice(start, stop - start), "n_tokens": pa.array(totals, pa.int64()), "kept_chars": pa.array(kept, pa.int64())})

    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, kept_chars long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "kept_chars")
