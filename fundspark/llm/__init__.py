"""Operations on text corpora: filtering, deduplication, mixing, packing and formatting."""
