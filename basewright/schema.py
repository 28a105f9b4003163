"""Schemas of reads and of the small tables that go with them."""

from __future__ import annotations

READS = "read_idx long, id string, seq string, qual string"
PAIRS = "read_idx long, id1 string, seq1 string, qual1 string, id2 string, seq2 string, qual2 string"
FASTA = "ord int, id string, seq string"
BARCODES = "ord int, barcode string, sample string"
BASES = "ATGCN"
OFFSETS = (33, 64)


def check_offset(phred: int) -> int:
    if phred not in OFFSETS:
        raise ValueError("phred must be 33 or 64")
    return phred
