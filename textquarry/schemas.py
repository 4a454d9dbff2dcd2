"""Declared schemas of the files the jobs read and write."""

CORPUS = "text string, citation string, jurisdiction string, type string"
RAW_TEXT = "text string"
PAIR = "question string, answer string, source string, jurisdiction string, type string"
OPEN_BOOK = "question string, context string"
CLOSED_RESULT = "q bigint, question string, answer string"
OPEN_RESULT = "row bigint, question string, context_length bigint, answer string"
LOSS = "step bigint, loss double"
COMPLETION = "doc_id bigint, response string, error_body string"
