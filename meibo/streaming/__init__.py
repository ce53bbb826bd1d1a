"""meibo.streaming"""
