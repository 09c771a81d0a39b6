"""Columns and types that the queries promise."""

import pytest
from conftest import SMALL

from fundspark.llm.registered import QUERIES

PROMISED = {
    "op2_hilbert_shards": "doc_id:bigint,size:bigint,text_crc32:bigint,law:string,shard:int,slot:bigint,grown_shard:int",
    "op3_language": "doc_id:bigint,held_out:boolean,lang_pred:string,score:double",
    "op4_risk_rules": "doc_id:bigint,n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,kept:boolean",
    "op5_lsh_forest": "doc_id:bigint,class_id:bigint,n_links:bigint",
    "op6_suffix_array": "doc_id:bigint,n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string",
    "op7_packing": "doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,sequence_id:bigint,offset:bigint",
    "op8_chat_parts": "conv_id:bigint,n_turns:bigint,turns_sha256:string,loss_chars:bigint,loss_sha256:string,formatted_chars:bigint",
    "op9_simhash": "doc_id:bigint,n_chars:bigint,edited_sha256:string,fingerprint:string,edited_fingerprint:string,near_edited:double,near_next:double",
}


@pytest.mark.parametrize("name", sorted(PROMISED))
def test_columns_and_types(spark, name):
    promised = [tuple(c.split(":")) for c in PROMISED[name].split(",")]
    assert QUERIES[name](spark, SMALL).dtypes[: len(promised)] == promised
