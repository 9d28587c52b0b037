"""The registered queries of the training-data operators and their SQL forms."""

from __future__ import annotations

from .centroid_clusters import ORACLE_SQL as CLUSTERS_SQL
from .centroid_clusters import op12_centroid_clusters
from .chat_tree import ORACLE_SQL as CHAT_SQL
from .chat_tree import op4_chat_tree
from .decontaminate import op3_decontaminate
from .filter_audit import ORACLE_SQL as AUDIT_SQL
from .filter_audit import op13_filter_audit
from .language_crf import op1_language_crf
from .line_dedup import ORACLE_SQL as LINES_SQL
from .line_dedup import op8_line_dedup
from .mixing import ORACLE_SQL as MIXING_SQL
from .mixing import op10_mixing
from .ngram_join import op5_ngram_join
from .quality_rules import ORACLE_SQL as QUALITY_SQL
from .quality_rules import op2_quality_rules
from .quality_trees import op11_quality_trees
from .secret_scan import op9_secret_scan
from .sharding import op7_sharding
from .token_files import op6_token_files

QUERIES = {
    "op1_language_crf": op1_language_crf,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontaminate": op3_decontaminate,
    "op4_chat_tree": op4_chat_tree,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_files": op6_token_files,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_mixing": op10_mixing,
    "op11_quality_trees": op11_quality_trees,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op2_quality_rules": QUALITY_SQL,
    "op4_chat_tree": CHAT_SQL,
    "op8_line_dedup": LINES_SQL,
    "op10_mixing": MIXING_SQL,
    "op12_centroid_clusters": CLUSTERS_SQL,
    "op13_filter_audit": AUDIT_SQL,
}
