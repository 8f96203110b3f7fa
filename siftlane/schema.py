"""Schemas of the tables."""

from __future__ import annotations

AUX = "array<struct<tag:string,type:string,array_type:string,int_val:bigint,dbl_val:double,str_val:string,arr_val:array<double>>>"
ALIGNMENTS = (
    "sample_id string, side string, ordinal bigint, qname string, flag int, ref_id int, ref_name string, pos bigint, mapq int, cigar string, "
    f"mate_ref_id int, mate_pos bigint, tlen int, seq string, qual binary, nm bigint, nm_type string, xg string, aux {AUX}"
)
REFERENCES = "sample_id string, side string, ref_id int, ref_name string, ref_len int"
TRUTH = "fragment_id string, known_source string"
AUDIT = "record_ordinal bigint, qname string, flag int, reference string, position_0_based bigint, cigar string, stored_nm bigint, nm bigint, insertions bigint, soft_clips bigint, classification_score bigint"
ORACLE = (
    "record_ordinal bigint, qname string, flag int, reference string, position_0_based bigint, cigar string, conventional_nm bigint, bisulfite_nm bigint, "
    "insertions bigint, deletions bigint, soft_clips bigint, bisulfite_conversions_ignored bigint, classification_score bigint"
)
DISAGREEMENTS = "fragment_id string, modern_classification string, legacy_classification string"
TILES = "contig string, tile_no bigint, seq string"
