"""Token ids of whole texts by a byte-level BPE vocabulary file."""

from __future__ import annotations

import json
import os
from functools import lru_cache

#: The pattern of byte-level pre-tokenizers (a fixed value of the format).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: visible Latin-1 stands for itself,
    the rest for 256 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a list of texts to their lists of ids.

    Special tokens' strings in a text are ordinary text.  Where the file's merges stand in the order of
    their ids, with the plain byte-level splitting, the same merges are run by ``tiktoken``, which
    gives the same ids several times faster; any other file is left to ``tokenizers``.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    letters = _byte_letters()
    vocab = {token: i for token, i in model.get("vocab", {}).items() if all(c in letters for c in token)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    made = ["".join(m) for m in merges]
    by_rank = (model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
               and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges") and len(set(made)) == len(made)
               and all(c in vocab for c in letters) and all(m in vocab for m in made)
               and all(vocab[x] < vocab[y] for x, y in zip(made, made[1:])) and max(vocab[c] for c in letters) < min(map(vocab.get, made), default=1 << 31))
    if not by_rank:
        return lambda texts: [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    ranks = {bytes(letters[c] for c in token): vocab[token] for token in [*letters, *made]}
    fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [fast.encode_ordinary(t) for t in texts]
