"""quorum.sources"""
