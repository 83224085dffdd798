"""Audits of a sample of the corpus by a language model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import no_model
from ..functions.text import fenced_json
from .sampling import stratified

#: framework: what to look at
FRAMEWORKS = {
    "GDPR": "lawful basis|consent|data subject rights|erasure|portability|breach notice|retention|transfers abroad|processors",
    "HIPAA": "patient data|access control|audit trail|encryption|minimum necessary|breach notice|business associates|training",
    "OWASP": "access control|cryptography|injection|insecure design|misconfiguration|outdated components|authentication|integrity|logging|request forgery",
    "PCI_DSS": "cardholder data|network security|encryption in transit|stored data|access control|monitoring|testing|policies",
    "SOC2": "security|availability|processing integrity|confidentiality|privacy|change management|incident response|vendors",
}
SAMPLE = 30


def scan(chunks: DataFrame, framework: str, sample: int = SAMPLE, llm: Callable[[str], str] = no_model, group: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """(framework, risk_score, summary, sampled, reply): one prompt over a stratified sample, its score clamped to 0-100."""
    focus = FRAMEWORKS[framework]
    taken = stratified(chunks, sample, group, order, empty_is_unknown=False)
    piece = F.concat(F.lit("["), F.coalesce(F.col(group).cast("string"), F.lit("unknown")), F.lit("]\n"), F.left(text, F.lit(600)))
    joined = taken.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))), lambda x: x["p"]), "\n---\n").alias("body"), F.count("*").alias("sampled"))
    from ..functions.models import per_text

    prompt = F.concat(F.lit(f"Framework {framework}. Look at: {focus.replace('|', ', ')}. Reply as JSON with risk_score and summary.\n"), F.left("body", F.lit(14000)))
    replied = joined.select("sampled", fenced_json(per_text(llm)(prompt)).alias("reply"))
    score = F.coalesce(F.try_to_number(F.get_json_object("reply", "$.risk_score"), F.lit("999")).cast("int"), F.lit(50))
    return replied.select(F.lit(framework).alias("framework"), F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("risk_score"), F.coalesce(F.get_json_object("reply", "$.summary"), F.lit("")).alias("summary"), "sampled", "reply")
