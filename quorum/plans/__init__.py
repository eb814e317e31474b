"""quorum.plans"""
