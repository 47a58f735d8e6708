"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontamination, jaccard, lexical, mixing, vector_codes, warc
from .chat import op2_perspectives
from .decontamination import op10_decontamination
from .jaccard import op8_jaccard
from .language_model import op6_language_model
from .lexical import op13_lexical_search
from .mixing import op5_mixing
from .quality_ranking import op7_quality_ranking
from .quality_rules import op1_quality_rules
from .secrets import op3_secrets
from .token_counts import op4_token_counts
from .toxicity import op11_toxicity
from .vector_codes import op12_vector_codes
from .warc import op9_warc

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_perspectives, op3_secrets, op4_token_counts, op5_mixing, op6_language_model, op7_quality_ranking, op8_jaccard, op9_warc, op10_decontamination, op11_toxicity, op12_vector_codes, op13_lexical_search)}
ORACLES: dict[str, str] = {"op2_perspectives": chat.ORACLE, "op5_mixing": mixing.ORACLE, "op8_jaccard": jaccard.ORACLE, "op9_warc": warc.ORACLE, "op10_decontamination": decontamination.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_lexical_search": lexical.ORACLE}
