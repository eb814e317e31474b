"""quorum.operators"""
