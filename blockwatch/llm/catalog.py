"""All registered queries of this subpackage (importing the modules fills the registries)."""

from blockwatch.llm import (  # noqa: F401
    bpe, decontaminate, divergence, fingerprint, html, license, manifest, near, pii, quality, substring, suffix, warc,
)
from blockwatch.llm.common import ORACLES, QUERIES  # noqa: F401
