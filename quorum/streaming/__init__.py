"""quorum.streaming"""
