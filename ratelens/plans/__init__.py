"""Registered queries: each plan composes operators over the star-schema tables and has,
where SQL can express it, an equivalent statement written independently for another engine.
"""
