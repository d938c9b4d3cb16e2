"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import audit, bpe, chat, embeddings, licenses, lines, merkle, mixing, pii, quality, secrets, simhash, sketch

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_licenses": licenses.op2_licenses,
    "op3_bpe": bpe.op3_bpe,
    "op4_quality": quality.op4_quality,
    "op5_fingerprints": sketch.op5_fingerprints,
    "op6_embeddings": embeddings.op6_embeddings,
    "op7_simhash": simhash.op7_simhash,
    "op8_lines": lines.op8_lines,
    "op9_chat": chat.op9_chat,
    "op10_secrets": secrets.op10_secrets,
    "op11_audit": audit.op11_audit,
    "op12_merkle": merkle.op12_merkle,
    "op13_pii": pii.op13_pii,
}
ORACLE_SQL = {"op1_mix": mixing.SQL, "op6_embeddings": embeddings.SQL, "op8_lines": lines.SQL, "op11_audit": audit.SQL, "op12_merkle": merkle.SQL}
