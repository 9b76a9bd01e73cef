"""Token counts with a whole-token shortcut (operator 9).

Offline, every vocabulary string is encoded alone and those that give one token are noted. A text is
cut into pre-tokens by the tokenizer's own pattern; pre-tokens in that list count one each, and only
the rest go through the merges, each distinct one once (their counts are remembered up to a bound).
A text with a character outside the alphabet for which our cutting is proven equal to the library's,
or with one of the tokenizer's special strings, goes through the library whole.

Defined results: null text counts as empty (0 bytes, 0 tokens); any length is counted whole; repeated
rows give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from barwright.llm.common import pieces

#: Remembered counts of merged pre-tokens in one worker; beyond it the memory is emptied.
REMEMBERED = 400_000
#: Characters whose cutting is tested against the library one by one.
TESTED = [chr(c) for c in (9, 10, 13, *range(32, 0x180)) if c != 0xAD]


def _load(spec: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def _classes(tok) -> tuple[str, str, str, str]:
    """Letters, digits, spaces and others of TESTED, as the library's normaliser and cutter take them;
    characters that it treats in any other way are left out."""
    kinds: dict[str, list[str]] = {"letter": [], "digit": [], "space": [], "other": []}

    def pieces(s: str) -> list[str]:
        return [x for x, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(s))]

    def bytes_as(s: str) -> str:
        return "".join(x for x, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(s))

    from tokenizers.pre_tokenizers import ByteLevel

    for c in TESTED:
        low = c.lower()
        if len(low) != 1:
            continue
        got, b = pieces(c + c), bytes_as(low)
        if not got:
            kinds["space"].append(c)
        elif tok.normalizer.normalize_str(c) != low:
            continue
        elif got == [b, b]:
            kinds["digit"].append(c)
        elif got == [b + b]:
            # a run with "b" on either side stays whole for a letter, and is cut for any other
            whole = pieces("b" + c + "b")
            kinds["letter" if whole == ["b" + b + "b"] else "other"].append(c)
    return tuple("".join(kinds[k]) for k in ("letter", "digit", "space", "other"))


@lru_cache(maxsize=4)
def _proven(spec: str) -> tuple[frozenset, str, str]:
    """The vocabulary strings that encode alone as one token, the cutting pattern, the alphabet."""
    tok = _load(spec)
    tok.no_padding(), tok.no_truncation()
    letters, digits, spaces, others = _classes(tok)
    lower = "".join(sorted({c.lower() for c in letters}))
    safe = "".join(sorted(set(letters + digits + spaces + others)))
    cutter = f"'s|'t|'re|'ve|'m|'ll|'d|[{re.escape(lower)}]+|[{re.escape(digits)}]|[{re.escape(others)}]+"
    model = json.loads(spec)["model"]
    end = model.get("end_of_word_suffix") or ""
    strings = [w for w in model["vocab"] if w.endswith(end)]
    plain = [tok.decoder.decode([w]).strip() if tok.decoder else w[: len(w) - len(end)] for w in strings]
    alike = sorted({p for p in plain if p and re.fullmatch(f"[{re.escape(safe)}]+", p) and p == p.lower()})
    whole = frozenset(p for p, e in zip(alike, tok.encode_batch(alike, add_special_tokens=False), strict=True)
                      if len(e.ids) == 1 and re.fullmatch(cutter, p))
    return whole, cutter, f"[^{re.escape(safe)}]"


class Counter:
    """Counts tokens of texts just as the library does."""

    def __init__(self, spec: str, whole: frozenset, cutter: str, unsafe: str):
        self.tok = _load(spec)
        self.tok.no_padding(), self.tok.no_truncation()
        self.special = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        self.whole, self.cut, self.unsafe = dict.fromkeys(whole, 1), re.compile(cutter).findall, re.compile(unsafe).search
        self.known = dict(self.whole)

    def _by_library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            if self.unsafe(t) or any(s in t for s in self.special):
                slow.append(i)
                continue
            parts = self.cut(t.lower())
            try:
                out[i] = sum(map(self.known.__getitem__, parts))
            except KeyError:
                rest = list({p for p in parts if p not in self.known})
                if len(self.known) + len(rest) > REMEMBERED + len(self.whole):
                    self.known = dict(self.whole)
                    rest = list({p for p in parts if p not in self.known})
                self.known.update(zip(rest, self._by_library(rest), strict=True))
                out[i] = sum(map(self.known.__getitem__, parts))
        for i, n in zip(slow, self._by_library([texts[i] for i in slow]), strict=True):
            out[i] = n
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; no shuffle. What is sent to the workers is
    bounded by the vocabulary file, which the driver reads once."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast((spec, *_proven(spec)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(*shipped.value)
        for b in pieces(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.selectExpr(f"cast({id_col} as bigint) as doc_id", f"{text_col} as text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
