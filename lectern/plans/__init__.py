"""lectern.plans"""
