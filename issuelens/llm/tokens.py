"""Token ids of texts, by a byte-level BPE vocabulary.

The ids are those of the tokenizers library for ``vocabulary`` (a .json file, control
strings taken as ordinary text). If a file of the same vocabulary as ranks (.tiktoken)
is given, texts without very long runs are encoded by it: the ids are the same, four
times faster. Long texts are encoded in segments cut where no token can span the cut:
before a single space that has a non-blank character on one side.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

from issuelens.llm.common import per_process

SEGMENT = 1 << 18  # characters of a text encoded at once
LONG_RUN = 2000  # characters without, or of nothing but, blanks

_LONG = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")


class Encoder:
    """``encode`` gives the ids of a text as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, vocabulary: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.fast = None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _segment(self, text: str) -> bytes:
        if self.fast is not None and not _LONG.search(text):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        out, at = [], 0
        while len(text) - at > SEGMENT:
            end = at + SEGMENT
            while 0 <= (end := text.find(" ", end)) < len(text) - 1 and text[end - 1].isspace() and text[end + 1].isspace():
                end += 1
            if end < 0 or end >= len(text) - 1:
                break
            out.append(self._segment(text[at:end]))
            at = end
        out.append(self._segment(text[at:]))
        return b"".join(out)


def encoder(vocabulary: str, ranks: str | None = None) -> Encoder:
    """The process's encoder for a vocabulary."""
    return per_process(f"encoder {vocabulary} {ranks}", lambda: Encoder(vocabulary, ranks))
