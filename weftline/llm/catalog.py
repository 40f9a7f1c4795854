"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import licenses, pq, secrets, topk
from .bpe import op5_bpe
from .licenses import op10_license_scan
from .minhash import op1_minhash_near_dedup
from .mixing import op9_mixing
from .pq import op3_embedding_near_dedup
from .quality import op4_quality_classifier
from .resharding import op8_resharding
from .secrets import op2_secret_scan
from .substrings import op6_substring_dedup
from .topk import op7_exact_topk

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_bpe": op5_bpe,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_exact_topk": op7_exact_topk,
    "op8_resharding": op8_resharding,
    "op9_mixing": op9_mixing,
    "op10_license_scan": op10_license_scan,
}

ORACLES: dict[str, str] = {
    "op2_secret_scan": secrets.SQL,
    "op3_embedding_near_dedup": pq.SQL,
    "op7_exact_topk": topk.SQL,
    "op10_license_scan": licenses.SQL,
}
