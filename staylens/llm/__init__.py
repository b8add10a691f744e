"""Training-data operators: deduplication, decontamination, language ID, URL and licence rules, chat
formatting, language-model scoring and source mixing, each a Spark job over whole tables."""
