"""Where the public tokenizer files are; installed beside Python, never copied here."""

from __future__ import annotations

import public_tokenizers

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
