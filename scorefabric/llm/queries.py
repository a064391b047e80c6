"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from scorefabric.llm.divergence import OP12_SQL, op12_source_divergence
from scorefabric.llm.exact import OP11_SQL, op11_exact_dedup
from scorefabric.llm.fingerprint import op1_fingerprints
from scorefabric.llm.idfile import op5_token_ids
from scorefabric.llm.jaccard import op10_jaccard_join
from scorefabric.llm.media import op4_media
from scorefabric.llm.packing import op9_packing
from scorefabric.llm.pieces import op7_pieces
from scorefabric.llm.search import OP13_SQL, op13_lexical_search
from scorefabric.llm.sharding import op2_sharding
from scorefabric.llm.suffix import op3_suffix_dedup
from scorefabric.llm.toxicity import op8_toxicity
from scorefabric.llm.warc import op6_warc

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_sharding": op2_sharding,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_media": op4_media,
    "op5_token_ids": op5_token_ids,
    "op6_warc": op6_warc,
    "op7_pieces": op7_pieces,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_lexical_search": op13_lexical_search,
}

#: The first ten have none: SQL gives neither their digests nor their ids nor trained scores; tests hold each against a brute-force version.
SQL: dict[str, str] = {"op11_exact_dedup": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_lexical_search": OP13_SQL}
