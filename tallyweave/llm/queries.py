"""The registered queries of this subpackage, one an operator, and their SQL."""

from __future__ import annotations

from .op1_repeats import op1_repeats
from .op2_quality import op2_quality
from .op3_packing import op3_packing
from .op4_style_tree import op4_style_tree
from .op5_shuffle import op5_shuffle
from .op6_secrets import op6_secrets
from .op7_templates import op7_templates
from .op8_simhash import op8_simhash
from .op9_warc import OP9_SQL, op9_warc
from .op10_tokens import op10_tokens
from .op11_spelling import OP11_SQL, op11_spelling
from .op12_collocations import OP12_SQL, op12_collocations
from .op13_licenses import OP13_SQL, op13_licenses

QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_style_tree": op4_style_tree,
    "op5_shuffle": op5_shuffle,
    "op6_secrets": op6_secrets,
    "op7_templates": op7_templates,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_tokens": op10_tokens,
    "op11_spelling": op11_spelling,
    "op12_collocations": op12_collocations,
    "op13_licenses": op13_licenses,
}

ORACLE_SQL: dict[str, str] = {"op9_warc": OP9_SQL, "op11_spelling": OP11_SQL, "op12_collocations": OP12_SQL, "op13_licenses": OP13_SQL}
