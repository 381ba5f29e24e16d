"""Readers and writers of transcripts, manifests, audio headers and corpora."""
