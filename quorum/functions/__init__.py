"""quorum.functions"""
