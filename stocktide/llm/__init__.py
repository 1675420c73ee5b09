"""Training-data operators: quality rules, packing, dedup, formatting, decontamination, counting, WARC, PII, binary output."""
