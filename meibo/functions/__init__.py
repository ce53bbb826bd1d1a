"""meibo.functions"""
