"""meibo.operators"""
