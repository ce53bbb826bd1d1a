"""meibo.sources"""
