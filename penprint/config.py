"""The preprocessing policy that a document view is built under."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

FORMATS = ("markdown", "html", "email", "code_fence")


@dataclass(frozen=True)
class PreprocessingConfig:
    """How text is normalized and cut into layers. The defaults are the policy for English."""

    unicode_normalization: str = "NFC"
    lowercase_tokens: bool = True
    normalize_whitespace: bool = True
    retain_urls: bool = True
    retain_numbers: bool = True
    special_token_policy: str = "raw_text"
    format_layers: tuple[str, ...] = FORMATS

    def __post_init__(self) -> None:
        if self.unicode_normalization not in ("NFC", "NFD", "NFKC", "NFKD", "none"):
            raise ValueError(f"no such normalization: {self.unicode_normalization}")
        if self.special_token_policy not in ("raw_text", "class_normalize"):
            raise ValueError(f"no such policy for special tokens: {self.special_token_policy}")
        if unknown := set(self.format_layers) - set(FORMATS):
            raise ValueError(f"no such format layers: {sorted(unknown)}")

    @property
    def config_hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


ENGLISH = PreprocessingConfig()
