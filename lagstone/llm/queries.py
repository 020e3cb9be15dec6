"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from lagstone.llm.bpe import op1_bpe
from lagstone.llm.decontaminate import OP13_SQL, op13_decontaminate
from lagstone.llm.infill import OP11_SQL, op11_infill
from lagstone.llm.jaccard import OP8_SQL, op8_jaccard_join
from lagstone.llm.materialise import op6_materialise
from lagstone.llm.media import op5_media
from lagstone.llm.mixing import OP4_SQL, op4_mixing
from lagstone.llm.quality import op3_quality
from lagstone.llm.sharding import OP2_SQL, op2_sharding
from lagstone.llm.suffix_dedup import OP7_SQL, op7_suffix_dedup
from lagstone.llm.token_counts import op10_token_counts
from lagstone.llm.toxicity import op9_toxicity
from lagstone.llm.variants import OP12_SQL, op12_variants

QUERIES = {f.__name__: f for f in (op1_bpe, op2_sharding, op3_quality, op4_mixing, op5_media, op6_materialise, op7_suffix_dedup, op8_jaccard_join, op9_toxicity, op10_token_counts, op11_infill, op12_variants, op13_decontaminate)}

ORACLES: dict[str, str] = {"op2_sharding": OP2_SQL, "op4_mixing": OP4_SQL, "op7_suffix_dedup": OP7_SQL, "op8_jaccard_join": OP8_SQL, "op11_infill": OP11_SQL, "op12_variants": OP12_SQL, "op13_decontaminate": OP13_SQL}
