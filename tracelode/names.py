"""Names that differ between installations: schema tags, kind prefix, format labels.

Captures written by another recorder carry that recorder's own tags; pass a
``Names`` with those values instead of editing code.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Names:
    context_schema: str = "context.v1"
    contract_schema: str = "contract.v1"
    memory_schema: str = "memory.v1"
    kind_prefix: str = "context_"
    pi_format: str = "pi-v3"
    generic_format: str = "generic-jsonl"
    loop_format: str = "loop-v1"
    loop_signature: str = "loop"
    retrieval_format: str = "retrieval-v1"
    contract_format: str = "pipeline-v1"
    memory_format: str = "memory-plane-v1"


DEFAULT = Names()
