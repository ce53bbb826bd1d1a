"""meibo.plans"""
