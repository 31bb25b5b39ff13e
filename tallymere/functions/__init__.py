"""Part of the document-ledger engine; see README.md."""
