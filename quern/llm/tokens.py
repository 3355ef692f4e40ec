"""Byte-level BPE ids at corpus speed.

The ids are those of the ``tokenizers`` file; the same vocabulary as ranks, in ``tiktoken``, gives them
several times faster.
"""

from __future__ import annotations

import base64
import os

import numpy as np


class ByteBpe:
    """``encode(text)``: ids as little-endian unsigned 32-bit bytes, without special tokens added.

    ``path`` names the tokenizer's JSON file; a ranks file of the same name with the ending
    ``.tiktoken`` is used beside it where there is one. A text that holds one of the tokenizer's special
    strings goes through the JSON file, which gives it that token's id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.ranks = None
        ranks = f"{path.removesuffix('.json')}.tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.ranks is None or any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_to_numpy(text, disallowed_special=())
        return np.asarray(ids, "<u4").tobytes()
