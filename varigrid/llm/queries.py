"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from varigrid.llm import centroids, decontamination, phrases, sharding
from varigrid.llm.centroids import op12_centroids
from varigrid.llm.decontamination import op9_decontamination
from varigrid.llm.embeddings import op1_embeddings
from varigrid.llm.language import op7_language
from varigrid.llm.minhash import op3_minhash
from varigrid.llm.packing import op4_packing
from varigrid.llm.phrases import op13_collocations
from varigrid.llm.quality import op2_quality
from varigrid.llm.secrets import op8_secrets
from varigrid.llm.sharding import op11_sharding
from varigrid.llm.suffixes import op10_suffixes
from varigrid.llm.token_files import op5_token_files
from varigrid.llm.toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_embeddings, op2_quality, op3_minhash, op4_packing, op5_token_files, op6_toxicity, op7_language, op8_secrets, op9_decontamination, op10_suffixes, op11_sharding, op12_centroids, op13_collocations)}
ORACLE: dict[str, str] = {"op9_decontamination": decontamination.ORACLE_SQL, "op11_sharding": sharding.ORACLE_SQL, "op12_centroids": centroids.ORACLE_SQL, "op13_collocations": phrases.ORACLE_SQL}
