"""The queries of this subpackage: name -> function of (spark, sf_dir); SQL where it can express the result."""

from __future__ import annotations

from .alignment import op13
from .decontaminate import op6
from .hard_negatives import op11
from .langid import op4
from .licences import op9
from .media import op10
from .ngram_join import op3
from .packing import op5
from .pii import op8
from .quality import op2
from .simhash import op12
from .suffix_dedup import op7
from .token_ids import op1

QUERIES = {
    "op1_token_ids": op1,
    "op2_quality": op2,
    "op3_ngram_join": op3,
    "op4_language_id": op4,
    "op5_best_fit_packing": op5,
    "op6_decontamination": op6,
    "op7_suffix_dedup": op7,
    "op8_pii": op8,
    "op9_licences": op9,
    "op10_media_copies": op10,
    "op11_hard_negatives": op11,
    "op12_simhash": op12,
    "op13_tokenizer_alignment": op13,
}

ORACLE: dict[str, str] = {}
