"""The document model: trees, schemas, the native markup, canonical form and content ids.

Everything here works on one document in memory. The Spark side (``quire.operators.documents``) applies it to
one row at a time inside Arrow batches and turns trees into interval-encoded node rows.
"""
