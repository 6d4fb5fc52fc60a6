"""The sequence and protein functions for SQL: temporary functions whose bodies are SQL, so that calls plan as built-ins.

    register(spark)
    spark.sql("select id, orf_longest(sequence) from sequences where gc_content(sequence) > 0.6")
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import protein as P
from helixframe.functions import sequence as S

#: The functions of one text, by name in SQL.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "reverse_complement": S.reverse_complement, "codons": S.codons, "translate_dna": S.translate_from, "translate_to_stop": S.translate_to_stop,
    "gc_content": S.gc_length, "gc_unambiguous": S.gc_unambiguous, "sequence_entropy": S.entropy, "purine_ratio": S.purine_ratio, "melting_temperature": S.melting,
    "repeat_score": S.repeat_score, "cpg_score": S.cpg_score, "periodicity": S.periodicity, "coding_potential": S.coding_potential, "codon_bias": S.codon_bias,
    "orf_longest": lambda s: S.inframe_orfs(s)["longest"], "orf_count": lambda s: S.inframe_orfs(s)["orfs"], "sequence_type": S.sequence_type, "header_label": S.header_label,
    "quality_issues": S.quality_issues, "virulence": S.virulence, "resistance": S.resistance, "phylogenetic_markers": S.phylogenetic_markers, "host_interaction": S.host_interaction,
    "hydrophobicity": P.hydrophobicity, "net_charge": P.net_charge, "secondary_structure": P.secondary_structure, "binding_potential": P.binding_potential,
    "residue_frequencies": P.residue_frequencies, "molecular_weight": P.molecular_weight, "isoelectric_point": P.isoelectric_point, "gene_function": P.gene_function,
}
#: A column's text: a quoted part, a number with a point, or an operator written before its operands in parentheses.
PART = re.compile(r"""'(?:\\.|[^'\\])*'|\b\d+\.\d+(?:E-?\d+)?|(?:[-+*/%=!<>]+|\b(?:and|or|not)\b)(?=\()""")


def text_of(column: Column) -> str:
    """SQL of a column of built-in functions: operators become functions of their names, and numbers with a point doubles."""
    shown = str(column)
    shown = shown[shown.index("'") + 1 : shown.rindex("'")]

    def part(m: re.Match) -> str:
        x = m[0]
        return x if x[0] == "'" else f"{x}D" if x[0].isdigit() else f"`{x}`"

    return PART.sub(part, shown)


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make FUNCTIONS known to SQL in this session, under their names after ``prefix``; functions of these names are replaced."""
    for name, make in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {prefix}{name}(s string) return {text_of(make(F.col('s')))}")
    return [prefix + name for name in FUNCTIONS]
